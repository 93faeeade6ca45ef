"""Line-based analysis of texts and source files (path or file, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean_comment, is_comment
from millrace.operators.running import running

# Names of languages by file extension; others are Other.
LANGUAGES = {
    "rs": "Rust", "py": "Python", "go": "Go", "js": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "java": "Java",
    "kt": "Kotlin", "kts": "Kotlin", "c": "C", "h": "C", "cpp": "C++", "hpp": "C++", "cc": "C++", "cxx": "C++", "cs": "C#", "rb": "Ruby", "php": "PHP",
    "swift": "Swift", "scala": "Scala", "sh": "Shell", "bash": "Shell", "ps1": "PowerShell", "lua": "Lua", "r": "R", "jl": "Julia", "dart": "Dart",
    "vue": "Vue", "svelte": "Svelte", "clj": "Clojure", "ex": "Elixir", "exs": "Elixir", "erl": "Erlang", "hs": "Haskell", "ml": "OCaml",
}
# Extensions of sources, names and extensions of configurations, kinds of symbols that can be exported.
SOURCES = (
    "rs", "py", "go", "js", "ts", "jsx", "tsx", "java", "kt", "kts", "c", "h", "cpp", "hpp", "cc", "cxx", "cs", "rb", "php", "swift", "scala",
    "clj", "ex", "exs", "erl", "hs", "ml", "lua", "sh", "bash", "ps1", "pl", "r", "jl", "dart", "vue", "svelte", "m", "mm",
)
CONFIG_NAMES = (
    "Cargo.toml", "Cargo.lock", "rust-toolchain", "rust-toolchain.toml", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", "CMakeLists.txt", "Makefile",
    "makefile", "GNUmakefile", "configure", "configure.ac", "meson.build", "BUILD", "BUILD.bazel", "WORKSPACE", "pom.xml", "build.gradle",
    "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "pyproject.toml", "setup.py", "setup.cfg", "requirements.txt",
    "Pipfile", "Pipfile.lock", "poetry.lock", "tox.ini", "pytest.ini", "mypy.ini", "ruff.toml", "package.json", "package-lock.json", "yarn.lock",
    "pnpm-lock.yaml", "tsconfig.json", ".eslintrc", ".eslintrc.json", ".prettierrc", "webpack.config.js", "vite.config.js", "rollup.config.js",
    "next.config.js", "nuxt.config.js", "packages.config", "Directory.Build.props", "global.json", "nuget.config", "go.mod", "go.sum", "Gemfile",
    "Gemfile.lock", "Rakefile", ".ruby-version", "composer.json", "composer.lock", "Dockerfile", "docker-compose.yml", "docker-compose.yaml",
    ".dockerignore", ".gitignore", ".gitattributes", "README.md", "README", "LICENSE", "LICENSE.md", "CHANGELOG.md", "CONTRIBUTING.md",
)
CONFIGS = ("csproj", "fsproj", "vbproj", "sln")
EXPORT_KINDS = ("function", "func", "fn", "struct", "class", "interface", "trait", "enum", "type", "typedef", "constant", "const", "static", "module", "namespace", "union", "protocol")

FUNCTION_KINDS = ("function", "func", "fn", "method")
# A declaration in Python whose first line that isn't blank opens a string: name, quotes, what is in them.
DOCSTRING = "(?ms)^[ \\t]*(?:async[ \\t]+)?(?:def|class)[ \\t]+(\\w+)[^\\n]*\\n(?:[ \\t\\r]*\\n)*[ \\t]*(\"\"\"|\u0027\u0027\u0027)(.*?)(?:\\2[ \\t\\r]*$|\\z)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def language(path: Column) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.element_at(names, extension(path)), F.lit("Other"))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., line_no from 1, line)."""
    rows = files.select(*keep, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def grep(lines: DataFrame, queries: list[str]) -> DataFrame:
    """Lines that match each expression: adds query (its place)."""
    hit = F.array_compact(F.array(*(F.when(F.col("line").rlike(q), F.lit(i)) for i, q in enumerate(queries))))
    return lines.where(F.col("line").rlike("|".join(f"(?:{q})" for q in queries))).withColumn("query", F.explode(hit))


def capped(hits: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` hits of each group."""
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= most).drop("nth")


def budgeted(hits: DataFrame, by: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Hits until their running size is over the budget: sums only grow, so the first overflow ends it. Keys of any size are summed in ranges."""
    return running(hits, by, order, {"used": size}).where(F.col("used") <= budget)


def line_kind(line: Column) -> Column:
    return F.when(F.trim(line) == "", "blank").when(is_comment(line), "comment").otherwise("code")


def line_stats(files: DataFrame, by: str) -> DataFrame:
    """(by, files, lines, code, comments, blanks, bytes), counted per file before anything is shuffled."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    count = lambda kind: F.size(F.filter(F.col("l"), lambda x: line_kind(x) == kind)).cast("bigint")
    rows = files.select(by, parts.alias("l"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    rows = rows.select(by, F.size("l").cast("bigint").alias("lines"), count("code").alias("code"), count("comment").alias("comments"), count("blank").alias("blanks"), "bytes")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("files"), *(F.sum(c).alias(c) for c in ("lines", "code", "comments", "blanks", "bytes")))


def imports(ext: Column, line: Column) -> Column:
    """Struct of target and whether it is internal, for one line; null for other lines."""
    take = lambda r: F.regexp_extract(line, r, 1)
    found = (
        F.when(ext == "rs", take("^\\s*(?:pub\\s+)?use\\s+([^;]+);"))
        .when(ext == "py", F.coalesce(F.nullif(take("^\\s*from\\s+(\\S+)\\s+import\\b"), F.lit("")), take("^\\s*import\\s+([\\w.]+)")))
        .when(ext.isin("js", "ts"), take("(?:from\\s+|require\\(|import\\s+)['\"]([^'\"]+)['\"]"))
        .when(ext.isin("c", "h", "cpp"), take("^\\s*#include\\s+[\"<]([^\">]+)[\">]"))
        .when(ext.isin("java", "kt", "scala"), take("^\\s*import\\s+(?:static\\s+)?([\\w.*]+)\\s*;"))
        .when(ext == "cs", take("^\\s*using\\s+([\\w.]+)\\s*;"))
        .when(ext == "go", take("^\\s*import\\s+\"([^\"]+)\""))
    )
    internal = (
        F.when(ext == "rs", found.rlike("^(crate|self|super)\\b"))
        .when(ext.isin("c", "h", "cpp"), line.rlike("^\\s*#include\\s+\""))
        .otherwise(found.startswith("."))
    )
    return F.when(F.coalesce(found, F.lit("")) != "", F.struct(F.trim(found).alias("target"), internal.alias("internal")))


def symbols(lines: DataFrame) -> DataFrame:
    """Declarations in Python, Rust, Go and JavaScript files: adds kind and name. Own rules, no external tool's."""
    rules = (
        ("function", "^\\s*(?:pub(?:\\([a-z]+\\))?\\s+)?(?:async\\s+)?fn\\s+(\\w+)"),
        ("function", "^\\s*(?:async\\s+)?def\\s+(\\w+)"),
        ("function", "^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)"),
        ("function", "^\\s*(?:export\\s+)?(?:async\\s+)?function\\s+(\\w+)"),
        ("class", "^\\s*(?:export\\s+)?(?:pub\\s+)?(?:class|struct|enum|trait|interface)\\s+(\\w+)"),
    )
    found = F.array_compact(
        F.array(*(F.when(F.regexp_extract("line", r, 1) != "", F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", r, 1).alias("name"))) for k, r in rules))
    )
    return lines.select("*", F.get(found, F.lit(0)).alias("s")).where("s IS NOT NULL").select(*lines.columns, "s.kind", "s.name")


def is_public(name: Column, ext: Column, declaration: Column) -> Column:
    """Whether a declaration is exported, by the rules of its language."""
    hidden = lambda *words: ~F.array_contains(F.array(*(declaration.contains(w) for w in words)), True)
    return (
        F.when(ext == "rs", F.ltrim(declaration).startswith("pub ") | F.ltrim(declaration).startswith("pub("))
        .when(ext == "go", name.rlike("^\\p{Lu}"))
        .when(ext == "py", ~name.startswith("_"))
        .when(ext.isin("js", "jsx", "ts", "tsx", "vue", "svelte"), declaration.contains("export "))
        .when(ext.isin("java", "cs", "scala"), declaration.contains("public "))
        .when(ext.isin("kt", "kts", "rb", "php", "swift"), hidden("private ", "internal ", "protected "))
        .when(ext.isin("c", "cpp", "cc", "cxx"), F.lit(False))
        .otherwise(F.lit(True))
    )


def doc_comments(lines: DataFrame, by: str) -> DataFrame:
    """Adds above: the comment over each code line, without its marks, in one line. Attributes and decorators between them are skipped; a blank or code line cuts."""
    order = Window.partitionBy(by).orderBy("line_no")
    attribute = F.trim("line").rlike("^(#!?\\[|@)")
    rows = lines.withColumn("kind_of", F.when(attribute, "attribute").otherwise(line_kind(F.col("line"))))
    rows = rows.withColumn("run", F.sum(F.when(F.col("kind_of").isin("comment", "attribute"), 0).otherwise(1)).over(order))
    comments = rows.where("kind_of = 'comment'").groupBy(by, "run").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("c"))
    cleaned = F.filter(F.transform("c", lambda x: clean_comment(x["line"])), lambda x: x != "")
    over = comments.select(by, (F.col("run") + 1).alias("run"), F.nullif(F.array_join(cleaned, " "), F.lit("")).alias("above"))
    return rows.where("kind_of = 'code'").join(over, [by, "run"], "left").drop("run", "kind_of")


def is_source(path: Column) -> Column:
    return extension(path).isin(*SOURCES)


def is_config(path: Column) -> Column:
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return name.isin(*CONFIG_NAMES) | extension(path).isin(*CONFIGS)


def exported(symbols: DataFrame, ext: str, line: str) -> DataFrame:
    """Symbols (kind, name) outside all scopes whose kind and declaration make them part of what a file offers."""
    top = ~F.col(line).rlike("^\\s")
    return symbols.where(top & F.lower("kind").isin(*EXPORT_KINDS) & is_public(F.col("name"), F.col(ext), F.col(line)))


def is_function(kind: Column) -> Column:
    return F.lower(kind).isin(*FUNCTION_KINDS)


def described(symbols: DataFrame, by: str, ext: str, line: str = "line") -> DataFrame:
    """Adds language, signature (the parameters in the declaration's line) and scope: the class above that an indented declaration is in, else null."""
    above = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    indented = F.col(line).rlike("^\\s")
    outer = F.last(F.when(~indented, F.struct("kind", "name")), ignorenulls=True).over(above)
    return symbols.select(
        "*",
        language(F.concat(F.lit("f."), F.col(ext))).alias("language"),
        F.nullif(F.regexp_extract(line, "(\\([^)]*\\))", 1), F.lit("")).alias("signature"),
        F.when(indented & (outer["kind"] == "class"), outer["name"]).alias("scope"),
    )


def docstrings(files: DataFrame, *keep: str) -> DataFrame:
    """(keep..., n, name, doc): documented declarations of Python texts in their order, the doc in one line; empty docs are left out."""
    names, docs = (F.regexp_extract_all("text", F.lit(DOCSTRING), F.lit(i)) for i in (1, 3))
    rows = files.select(*keep, F.posexplode(F.arrays_zip(names.alias("name"), docs.alias("doc"))).alias("n", "d"))
    space = F.lit(" \t\r")
    doc = F.btrim(F.array_join(F.transform(F.split("d.doc", "\n"), lambda x: F.btrim(x, space)), " "), space)
    return rows.select(*keep, "n", "d.name", doc.alias("doc")).where("doc <> ''")


def file_doc(text: Column) -> Column:
    """The comments that a text starts with, within its first 30 lines, without marks and in one line; null without any."""
    first = F.slice(F.split(text, "\n"), 1, 30)
    ends = F.array_min(F.transform(first, lambda x, i: F.when(~is_comment(x) & (F.trim(x) != ""), i)))
    cleaned = F.transform(F.slice(first, F.lit(1), F.coalesce(ends, F.size(first))), lambda x: clean_comment(x))
    return F.nullif(F.array_join(F.filter(cleaned, lambda x: x != ""), " "), F.lit(""))
