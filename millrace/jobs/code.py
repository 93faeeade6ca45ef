"""Line queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.jobs.base import Jobs, table
from millrace.operators import chunking
from millrace.operators import code as C
from millrace.operators import imports as O
from millrace.operators import lexer as L

JOBS = Jobs()
QUERIES = ["(?i)licen[sc]e", "^\\s*\\S+\\s*$", "[0-9]{3,}"]

LINES = "WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line_no FROM documents)"
HITS = LINES + r""", h AS (SELECT doc_id, source, line_no, line, 0 AS query FROM l WHERE regexp_matches(line, '(?i)licen[sc]e')
  UNION ALL SELECT doc_id, source, line_no, line, 1 FROM l WHERE regexp_matches(line, '^\s*\S+\s*$') UNION ALL SELECT doc_id, source, line_no, line, 2 FROM l WHERE regexp_matches(line, '[0-9]{3,}'))"""
KIND = r"CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^(//|/\*|\*|#|--|;;|%%)') THEN 'comment' ELSE 'code' END"
STATS = LINES + f""", k AS (SELECT *, {KIND} AS kind FROM l),
s AS (SELECT {{0}}, count(DISTINCT doc_id) AS files, count(*) AS lines, count(*) FILTER (WHERE kind = 'code') AS code, count(*) FILTER (WHERE kind = 'comment') AS comments,
  count(*) FILTER (WHERE kind = 'blank') AS blanks FROM k GROUP BY {{0}}), b AS (SELECT {{0}}, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY {{0}})
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grep(C.lines(_docs(spark, sf_dir), "doc_id", "source"), QUERIES)


@JOBS.add(HITS + "SELECT query, doc_id, line_no, line FROM h")
def grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("query", "doc_id", "line_no", "line")


@JOBS.add(HITS + """, u AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY source ORDER BY query, doc_id, line_no) AS used FROM h)
SELECT source, query, doc_id, line_no, used::BIGINT AS used FROM u WHERE used <= 4096""")
def grep_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source the matches in order until 4 KiB are full."""
    size = F.octet_length("line").cast("bigint")
    return C.budgeted(_hits(spark, sf_dir), ["source"], ["query", "doc_id", "line_no"], size, 4096).select("source", "query", "doc_id", "line_no", "used")


@JOBS.add(HITS + """, u AS (SELECT *, row_number() OVER (PARTITION BY query, doc_id ORDER BY line_no) AS nth FROM h) SELECT query, doc_id, line_no FROM u WHERE nth <= 3""")
def grep_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three matches of each query in each file."""
    return C.capped(_hits(spark, sf_dir), ["query", "doc_id"], ["line_no"], 3).select("query", "doc_id", "line_no")


@JOBS.add(STATS.format("lang") + "SELECT lang, files, lines, code, comments, blanks, bytes FROM s JOIN b USING (lang)")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.line_stats(_docs(spark, sf_dir), "lang")


@JOBS.add(STATS.format("lang") + """SELECT coalesce(lang, 'total') AS lang, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
sum(bytes)::BIGINT AS bytes FROM s JOIN b USING (lang) GROUP BY ROLLUP (lang)""")
def line_stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.line_stats(_docs(spark, sf_dir), "lang").rollup("lang").agg(*(F.sum(c).alias(c) for c in ("files", "lines", "code", "bytes")))
    return rows.withColumn("lang", F.coalesce("lang", F.lit("total")))


@JOBS.add(STATS.format("source") + """, d AS (SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source)
SELECT source, files, lines, code, langs FROM s JOIN d USING (source)""")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a module: files, lines and its languages in order."""
    langs = _docs(spark, sf_dir).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    return C.line_stats(_docs(spark, sf_dir), "source").select("source", "files", "lines", "code").join(langs, "source")


@JOBS.add(LINES + r""", m AS (SELECT doc_id, line_no, trim(replace(line, '*', '')) AS said, (doc_id + line_no) % 9 AS k FROM l)
SELECT doc_id, line_no, said AS comment FROM m WHERE k < 8""")
def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the documents as comments in eight notations (every ninth stays code), read back without the marks."""
    marks = F.array(*map(F.lit, ("// ", "# ", "/* ", " * ", "-- ", ";; ", "  %% ", "//! ", "x = ")))
    rows = C.lines(_docs(spark, sf_dir), "doc_id").withColumn("k", ((F.col("doc_id") + F.col("line_no")) % 9).cast("int"))
    said = F.trim(F.regexp_replace("line", "\\*", ""))
    rows = rows.withColumn("line", F.concat(F.element_at(marks, F.col("k") + 1), said, F.when(F.col("k") == 2, F.lit(" */")).otherwise(F.lit(""))))
    rows = rows.where(X.is_comment(F.col("line")))
    return rows.select("doc_id", "line_no", X.clean_comment(F.col("line")).alias("comment"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made of the pages: the links of a page are what its file imports and declares."""
    ext = F.element_at(F.array(*map(F.lit, ("py", "js", "rs", "c"))), (F.col("page_id") % 4 + 1).cast("int"))
    links = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))
    line = lambda w: (
        F.when(ext == "py", F.concat(F.lit("from ."), w, F.lit(" import x\ndef _"), w, F.lit("():")))
        .when(ext == "js", F.concat(F.lit("import a from '"), w, F.lit("'\nexport function "), w, F.lit("() {}")))
        .when(ext == "rs", F.concat(F.lit("use crate::"), w, F.lit(";\npub fn "), w, F.lit("() {}")))
        .otherwise(F.concat(F.lit("#include <"), w, F.lit(".h>\n// "), w))
    )
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), F.array_join(F.transform(links, line), "\n").alias("text"))


LINKS = r"""WITH w AS (SELECT page_id, page_id % 4 AS k, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1) AS w FROM pages))"""


@JOBS.add(LINKS + """SELECT page_id, CASE k WHEN 0 THEN '.' || w WHEN 1 THEN w WHEN 2 THEN 'crate::' || w ELSE w || '.h' END AS target, k IN (0, 2) AS internal, count(*) AS n FROM w GROUP BY ALL""")
def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.lines(_sources(spark, sf_dir), "page_id", "ext").select("page_id", C.imports(F.col("ext"), F.col("line")).alias("i")).where("i IS NOT NULL")
    return rows.groupBy("page_id", "i.target", "i.internal").agg(F.count(F.lit(1)).alias("n"))


@JOBS.add(LINKS + """SELECT page_id, (2 * i + 2)::INTEGER AS line_no, CASE WHEN k = 0 THEN '_' || w ELSE w END AS name, k <> 0 AS public FROM w WHERE k <> 3""")
def public_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.symbols(C.lines(_sources(spark, sf_dir), "page_id", "ext"))
    return s.select("page_id", "line_no", "name", C.is_public(F.col("name"), F.col("ext"), F.col("line")).alias("public"))


@JOBS.add(LINKS + """, s AS (SELECT page_id, k, count(*) AS symbols FROM w WHERE k <> 3 GROUP BY page_id, k), f AS (SELECT page_id % 4 AS k, page_id FROM pages)
SELECT CASE f.k WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'Rust' ELSE 'C' END AS language, count(*) AS files, sum(coalesce(symbols, 0))::BIGINT AS symbols
FROM f LEFT JOIN s USING (page_id) GROUP BY f.k""")
def project_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their symbols, if any, rolled up by language."""
    files = _sources(spark, sf_dir)
    symbols = C.symbols(C.lines(files, "page_id", "ext")).groupBy("page_id").agg(F.count(F.lit(1)).alias("symbols"))
    rows = files.select("page_id", C.language(F.concat(F.lit("f."), "ext")).alias("language")).join(symbols, "page_id", "left")
    return rows.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("symbols", F.lit(0))).alias("symbols"))


@JOBS.add(STATS.format("lang") + """SELECT coalesce(lang, '') AS lang, code, row_number() OVER (ORDER BY code DESC, lang NULLS LAST)::INTEGER AS place FROM s""")
def languages_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages by their lines of code, most first: a row for each language is ordered."""
    rows = C.line_stats(_docs(spark, sf_dir), "lang")
    return rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "code", F.row_number().over(Window.orderBy(F.desc("code"), F.col("lang").asc_nulls_last())).alias("place"))


@JOBS.add(LINKS + """, f AS (SELECT page_id, page_id % 4 AS k, unnest(w) AS w FROM (SELECT page_id, list_distinct(regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1)) AS w FROM pages))
SELECT page_id, w AS name FROM f WHERE k IN (1, 2)""")
def module_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file offers: its distinct public symbols of the exported kinds outside all scopes."""
    s = C.symbols(C.lines(_sources(spark, sf_dir), "page_id", "ext"))
    return C.exported(s, "ext", "line").select("page_id", "name").distinct()


KINDS = """WITH k(i, path, source, config, language) AS (VALUES (0, 'src/m.RS', true, false, 'Rust'), (1, 'a/Makefile', false, true, 'Other'), (2, 'b.d/conf.yaml', false, false, 'Other'),
  (3, 'x/notes.txt', false, false, 'Other'), (4, 'lib/v.tsx', true, false, 'TypeScript'), (5, 'Dockerfile', false, true, 'Other'), (6, 'go.mod', false, true, 'Other'),
  (7, 'p/setup.py', true, true, 'Python'), (8, 'pom.xml', false, true, 'Other'), (9, 'README.md', false, true, 'Other'), (10, 'w/App.CSPROJ', false, true, 'Other'), (11, 'w/all.sln', false, true, 'Other'),
  (12, 'a.json', false, false, 'Other'), (13, 'b.toml', false, false, 'Other'), (14, 'c/package.json', false, true, 'Other'), (15, 'd/build.gradle.kts', true, true, 'Kotlin'), (16, 'e.hpp', true, false, 'C++'),
  (17, 'f.bash', true, false, 'Shell'), (18, 'g.ps1', true, false, 'PowerShell'), (19, 'h.lua', true, false, 'Lua'), (20, 'i.sql', false, false, 'Other'), (21, 'j.html', false, false, 'Other'),
  (22, 'k.jsx', true, false, 'JavaScript'), (23, 'l.cxx', true, false, 'C++'), (24, 'm.exs', true, false, 'Elixir'), (25, 'n.pl', true, false, 'Other'), (26, 'o.ml', true, false, 'OCaml'), (27, '.gitignore', false, true, 'Other'))
SELECT path, source, config, language, count(*) AS n FROM pages JOIN k ON page_id % 28 = i GROUP BY ALL"""
PATHS = (
    "src/m.RS", "a/Makefile", "b.d/conf.yaml", "x/notes.txt", "lib/v.tsx", "Dockerfile", "go.mod", "p/setup.py", "pom.xml", "README.md", "w/App.CSPROJ", "w/all.sln", "a.json", "b.toml",
    "c/package.json", "d/build.gradle.kts", "e.hpp", "f.bash", "g.ps1", "h.lua", "i.sql", "j.html", "k.jsx", "l.cxx", "m.exs", "n.pl", "o.ml", ".gitignore",
)


@JOBS.add(KINDS)
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files are sources and which configurations, and their languages."""
    names = F.array(*map(F.lit, PATHS))
    rows = table(spark, sf_dir, "pages").select(F.element_at(names, (F.col("page_id") % len(PATHS) + 1).cast("int")).alias("path"))
    path = F.col("path")
    return rows.groupBy("path", C.is_source(path).alias("source"), C.is_config(path).alias("config"), C.language(path).alias("language")).agg(F.count(F.lit(1)).alias("n"))


DECLARED = (
    ("rs", "a", "pub fn a()"), ("rs", "b", "fn b() { \"pub \" }"), ("go", "Up", "func Up()"), ("go", "low", "func low()"), ("py", "_x", "def _x():"), ("py", "x", "def x():"), ("jsx", "f", "export function f()"),
    ("tsx", "g", "function g()"), ("vue", "h", "export const h"), ("svelte", "i", "let i"), ("java", "j", "public int j()"), ("scala", "k", "def k"), ("kts", "l", "internal fun l()"), ("kt", "m", "fun m()"),
    ("rb", "n", "protected def n"), ("php", "o", "function o()"), ("swift", "p", "internal func p()"), ("cc", "q", "int q()"), ("cxx", "r", "int r()"), ("h", "s", "int s();"), ("hpp", "t", "int t();"),
    ("lua", "u", "function u()"), ("dart", "v", "private v"), ("cs", "w", "int w()"),
)
PUBLIC = "rs:a go:Up py:x jsx:f vue:h java:j kt:m php:o h:s hpp:t lua:u dart:v"


@JOBS.add(f"""SELECT ext, name, list_contains(string_split('{PUBLIC}', ' '), ext || ':' || name) AS public, count(*) AS n FROM pages
JOIN (VALUES {", ".join(f"({i}, '{e}', '{n}')" for i, (e, n, _) in enumerate(DECLARED))}) AS d(i, ext, name) ON page_id % {len(DECLARED)} = i GROUP BY ALL""")
def exports_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which declarations are public in their languages."""
    known = F.array(*(F.struct(F.lit(e).alias("ext"), F.lit(n).alias("name"), F.lit(d).alias("line")) for e, n, d in DECLARED))
    rows = table(spark, sf_dir, "pages").select(F.element_at(known, (F.col("page_id") % len(DECLARED) + 1).cast("int")).alias("d")).select("d.*")
    public = C.is_public(F.col("name"), F.col("ext"), F.col("line")).alias("public")
    return rows.groupBy("ext", "name", public).agg(F.count(F.lit(1)).alias("n"))


@JOBS.add(LINKS + "SELECT page_id, count(*) AS functions FROM w WHERE k <> 3 GROUP BY page_id")
def function_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = C.symbols(C.lines(_sources(spark, sf_dir), "page_id", "ext")).where(C.is_function(F.col("kind")))
    return s.groupBy("page_id").agg(F.count(F.lit(1)).alias("functions"))


@JOBS.add(LINKS + """SELECT page_id, (2 * i + 2)::INTEGER AS line_no, CASE k WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' ELSE 'Rust' END AS language, '()' AS signature,
NULL::VARCHAR AS scope FROM w WHERE k <> 3""")
def described_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, parameters and enclosing class of each declaration."""
    s = C.symbols(C.lines(_sources(spark, sf_dir), "page_id", "ext"))
    return C.described(s, "page_id", "ext").select("page_id", "line_no", "language", "signature", "scope")


@JOBS.add("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), t AS (SELECT doc_id,
  trim(array_to_string(list_transform(l, lambda x: trim(x, ' ' || chr(9) || chr(13))), ' '), ' ' || chr(9) || chr(13)) AS doc FROM d)
SELECT doc_id, 0 AS n, 'd' || doc_id AS name, doc FROM t WHERE doc <> ''""")
def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the string under a declaration, read back in one line."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    text = F.concat(F.lit("x = 1\ndef "), name, F.lit('():\n\n    \"\"\"\n'), F.col("text"), F.lit('\n    \"\"\"\n    pass\ndef f():\n    pass\n'))
    return C.docstrings(_docs(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id")


@JOBS.add("""WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1) AS w FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 3 AND len(w) > 0 THEN array_to_string(list_transform(w[1:15], lambda x: 'include <' || x || '.h> ' || x), ' ') END AS doc FROM p""")
def file_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments that each file starts with."""
    return _sources(spark, sf_dir).select("page_id", C.file_doc(F.col("text")).alias("doc"))


NESTED = r"""WITH w AS (SELECT page_id, page_id % 3 AS k, unnest(list_transform(w, lambda x: 'x' || x)) AS w, unnest(range(len(w))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="/([A-Za-z]+)"', 1) AS w FROM pages))"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files made of the links of pages: for each a class in a class, in Python, a module in Rust, a class with comments in JavaScript."""
    ext = F.element_at(F.array(*map(F.lit, ("py", "rs", "js"))), (F.col("page_id") % 3 + 1).cast("int"))
    links = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))
    forms = {
        "py": 'class W_:\n    """Doc of\n    it."""\n    class In:\n        def _(\n            self,\n            x: int,\n        ) -> int:\n            return "def no(): # {" if x and 1 else 2\n    def tail(self): pass\n',
        "rs": "pub mod m_ {\n/* one {\n   fn no() {}\n*/\n    struct S {\n    }\n    impl S {\n        fn _(\n            a: u8, // no\n        ) -> u8\n        {\n            if a > 1 && true { 1 }\n        }\n    }\n}\n",
        "js": "// class No {\nexport class K_ {\n  x = 'function no() {';\n}\nfunction _(a) { while (a) { a = a || `\nfunction no() {\n`; } }\n",
    }
    form = F.element_at(F.create_map(*(F.lit(x) for kv in forms.items() for x in kv)), ext)
    text = F.array_join(F.transform(links, lambda w: F.replace(form, F.lit("_"), F.concat(F.lit("x"), w))), "")
    return table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), text.alias("text"))


@JOBS.add(NESTED + """, s(k, line, kind, name, scope, signature) AS (VALUES (0, 1, 'class', 'W_', NULL, NULL), (0, 4, 'class', 'In', 'W_', NULL), (0, 5, 'method', '_', 'W_.In', '( self, x: int, ) -> int'), (0, 10, 'method', 'tail', 'W_', '(self)'),
  (1, 1, 'module', 'm_', NULL, NULL), (1, 5, 'class', 'S', 'm_', NULL), (1, 7, 'implementation', 'S', 'm_', NULL), (1, 8, 'method', '_', 'm_.S', '( a: u8, ) -> u8'),
  (2, 2, 'class', 'K_', NULL, NULL), (2, 5, 'function', '_', NULL, '(a)'))
SELECT page_id, (i * CASE k WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 7 END + line)::INTEGER AS line_no, kind, replace(name, '_', w) AS name, replace(scope, '_', w) AS scope, signature FROM w JOIN s USING (k)""")
def scoped_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations with the chain of what they are in, and signatures over lines."""
    return L.scoped_symbols(_nested(spark, sf_dir), "page_id").drop("ext")


@JOBS.add(NESTED + """, e(k, ext) AS (VALUES (0, 'py'), (1, 'rs'), (2, 'js')), n AS (SELECT k, count(*) AS n FROM w GROUP BY k),
f AS (SELECT page_id % 3 AS k, count(*) AS files FROM pages GROUP BY ALL)
SELECT ext, files, (files + n * CASE k WHEN 0 THEN 10 WHEN 1 THEN 15 ELSE 7 END)::BIGINT AS lines, (n * CASE k WHEN 0 THEN 8 WHEN 1 THEN 12 ELSE 6 END)::BIGINT AS code,
  (n * CASE k WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END)::BIGINT AS comments, files AS blanks, (n * 2)::BIGINT AS complexity FROM f JOIN n USING (k) JOIN e USING (k)""")
def lexed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of code, comments and blanks with complexity, told over line ends."""
    return L.lexed_stats(_nested(spark, sf_dir), "ext").drop("bytes")


@JOBS.add(LINKS + """, p(k, b, a, c) AS (VALUES (0, '.', '', true), (1, './', '', true), (2, 'crate::', '', true), (3, '', '.h', false)),
f AS (SELECT page_id, k, w, min(i) AS i FROM w GROUP BY ALL)
SELECT page_id, coalesce(string_agg(b || w || a, ' ' ORDER BY i) FILTER (WHERE c), '') AS internal,
  coalesce(string_agg(CASE WHEN k = 3 THEN w || '.h' ELSE 'x' || w END, ' ' ORDER BY i), '') AS external FROM f JOIN p USING (k) GROUP BY page_id""")
def ordered_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages as imports of a file's own parts and of others, in block comments too, which don't count."""
    ext = F.element_at(F.array(*map(F.lit, ("py", "js", "rs", "c"))), (F.col("page_id") % 4 + 1).cast("int"))
    links = F.regexp_extract_all("html", F.lit('href="/([A-Za-z]+)"'), F.lit(1))
    forms = {
        "py": "from ._ import a\nimport x_ as b, x_\n# from c import d\n",
        "js": "import { a } from './_';\nconst b = require('x_');\n/* one\nimport c from 'no';\n*/\n",
        "rs": "  use crate::_;\nuse x_;\n/* two */ // not one\n// use no;\n",
        "c": "#include <_.h>\n/* #include <no.h>\n#include <no.h> */\n",
    }
    form = F.element_at(F.create_map(*(F.lit(x) for kv in forms.items() for x in kv)), ext)
    text = F.array_join(F.transform(links, lambda w: F.replace(form, F.lit("_"), w)), "")
    out = O.ordered_imports(table(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), text.alias("text")), "page_id")
    return out.select("page_id", F.array_join("internal", " ").alias("internal"), F.array_join("external", " ").alias("external"))


@JOBS.add()
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.symbols(C.lines(_sources(spark, sf_dir), "page_id", "ext")).select("page_id", "line_no", "kind", "name")


@JOBS.add()
def doc_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.doc_comments(C.lines(_sources(spark, sf_dir), "page_id"), "page_id")


@JOBS.add()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(_docs(spark, sf_dir))
