"""Source files by their lexemes: comments and strings over line ends, complexity, nested scopes, signatures over lines.

A language family is one regular expression whose alternatives are comments, strings and the rest: a finite automaton
that the JVM runs over the whole text, so what a line is follows from all lines before it. Comments and strings are
masked character by character and line ends stay; all further questions are asked of the masked lines. Scopes come from depths:
prefix sums of braces, or indentation, give the depth of each line; the lines that bring it back close the
declarations of the depths between; and at each depth the last declaration that is still open is what a symbol is in.
The rules are this library's own, no external tool's.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMMENT, STRING, ESCAPED, OPENS, GOES_ON = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"
_BLOCK, _SLASHES = "/\\*.*?(?:\\*/|\\z)", "//[^\\n]*"
_TWO, _ONE, _TICK = '"[^"\\n]*"?', "'[^'\\n]*'?", "`[^`]*`?"
_CHAR = "'(?:[^'\\n]|\\\\[^'\\n]{1,10})'"
_HASH = "#[^\\n]*"
_TRIPLE = f'"""(?:.*?)(?:{OPENS}?"""|\\z)', f"'''(?:.*?)(?:{OPENS}?'''|\\z)"
#: Of each family: extensions, comments, strings, what begins a comment, what adds to complexity.
FAMILIES = {
    "c": (("c", "h", "cpp", "hpp", "cc", "cxx", "java", "kt", "kts", "cs", "go", "swift", "scala", "m", "mm"), (_BLOCK, _SLASHES), (_TWO, _CHAR, _TICK), "/[/*]", "c"),
    "rust": (("rs",), (_BLOCK, _SLASHES), ('"[^"]*"?', _CHAR), "/[/*]", "c"),
    "js": (("js", "jsx", "ts", "tsx", "vue", "svelte", "php", "dart"), (_BLOCK, _SLASHES), (_TWO, _ONE, _TICK), "/[/*]", "c"),
    "python": (("py",), (OPENS + _TRIPLE[0], OPENS + _TRIPLE[1], _HASH), (*_TRIPLE, _TWO, _ONE), f"[#{OPENS}]", "python"),
    "hash": (("sh", "bash", "rb", "pl", "r", "jl", "ex", "exs", "ps1"), (_HASH,), ('"[^"]*"?', _ONE), "#", "hash"),
    "lua": (("lua",), ("--\\[\\[.*?(?:\\]\\]|\\z)", "--[^\\n]*"), (_TWO, _ONE), "--", "hash"),
    "haskell": (("hs",), ("\\{-.*?(?:-\\}|\\z)", "--[^\\n]*"), (_TWO,), "(?:--|\\{-)", "hash"),
    "ml": (("ml",), ("\\(\\*.*?(?:\\*\\)|\\z)",), (_TWO,), "\\(\\*", "hash"),
    "lisp": (("clj",), (";[^\\n]*",), ('"[^"]*"?',), ";", "hash"),
    "erlang": (("erl",), ("%[^\\n]*",), (_TWO,), "%", "hash"),
}
BRANCHES = {
    "c": "\\b(?:if|for|while|case|catch|match)\\b|&&|\\|\\|",
    "python": "\\b(?:if|elif|for|while|except|and|or)\\b",
    "hash": "\\b(?:if|elif|elsif|elseif|for|while|until|when|rescue)\\b|&&|\\|\\|",
}
DECLARATIONS = (
    ("module", "^\\s*(?:export\\s+)?(?:pub(?:\\([a-z]+\\))?\\s+)?(?:mod|namespace|module)\\s+(\\w+)"),
    ("implementation", "^\\s*impl\\b(?:<[^{]*?>)?\\s+(?:[\\w:<>]+\\s+for\\s+)?(\\w+)"),
    ("class", "^\\s*(?:export\\s+)?(?:(?:pub(?:\\([a-z]+\\))?|public|abstract|final|static|default)\\s+)*(?:class|struct|enum|trait|interface|union)\\s+(\\w+)"),
    ("function", "^\\s*(?:pub(?:\\([a-z]+\\))?\\s+)?(?:(?:async|const|unsafe|override|public|private|internal|static)\\s+)*(?:fn|fun)\\s+(\\w+)"),
    ("function", "^\\s*(?:async\\s+)?def\\s+(\\w+)"),
    ("function", "^func\\s+(?:\\([^)]*\\)\\s*)?(\\w+)"),
    ("function", "^\\s*(?:export\\s+)?(?:default\\s+)?(?:async\\s+)?function\\s+(\\w+)"),
)
_ANY = "|".join(f"(?:{r})" for _, r in DECLARATIONS)
_PARAMETERS = "^[^(){};\\n]*?(\\([^()]*(?:\\([^()]*\\)[^()]*)*\\)(?:\\s*->\\s*[^:{;\\n]+)?)"
AHEAD = 16  # lines that a signature may take


def _family(ext: Column, value) -> Column:
    """``value`` of the family's row, null for other extensions."""
    out = None
    for exts, *rest in FAMILIES.values():
        out = F.when(ext.isin(*exts), value(*rest)) if out is None else out.when(ext.isin(*exts), value(*rest))
    return out


def masked(text: Column, ext: Column) -> Column:
    """The text with each character of a comment, and of a string, replaced by a mark, and one more where a string goes on in a line; texts of unknown languages stay."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\\\\[\\\\\"'`]", ESCAPED * 2)
    text = F.when(ext == "py", F.regexp_replace(text, "(?<![^\\n])([ \\t]*)(\"\"\"|''')", "$1" + OPENS + "$2")).otherwise(text)

    def lexed(comments: tuple, strings: tuple, begins: str, _) -> Column:
        rule = "(?s)" + "|".join((*comments, *strings)) + "|[^\"'`/#;%{(\\-" + OPENS + "]+|."
        token = lambda t: F.when(t.rlike(f"^{begins}") & t.rlike("(?s)^(?:" + "|".join(comments) + ")\\z"), F.regexp_replace(t, "[^\\n]", COMMENT)).when(
            t.rlike("^[\"'`]") & (F.length(t) > 1), F.regexp_replace(F.regexp_replace(t, "[^\\n]", STRING), "\\n", "\n" + GOES_ON)
        ).otherwise(t)
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), token), "")

    return F.coalesce(_family(ext, lexed), text)


def line_kind(line: Column) -> Column:
    """Of a masked line."""
    return F.when(line.rlike(f"[^\\s{COMMENT}]"), "code").when(line.contains(COMMENT), "comment").otherwise("blank")


def lexed_stats(files: DataFrame, by: str, ext: str = "ext") -> DataFrame:
    """(by, files, lines, code, comments, blanks, complexity, bytes) of (by, ext, text): all of a file is told in its row, then summed.

    complexity counts branches and logical operators in code. A null text is an empty file.
    """
    rows = files.select(by, F.col(ext).alias("x"), masked(F.col("text"), F.col(ext)).alias("m"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("bytes"))
    lines = F.split("m", "\n")
    count = lambda kind: F.size(F.filter(lines, lambda x: line_kind(x) == kind)).cast("bigint").alias(kind)
    branches = F.coalesce(_family(F.col("x"), lambda *r: F.regexp_count("m", F.lit(BRANCHES[r[3]]))), F.lit(0)).cast("bigint")
    told = rows.select(by, F.size(lines).cast("bigint").alias("lines"), count("code"), count("comment"), count("blank"), branches.alias("complexity"), "bytes")
    sums = (F.sum("lines").alias("lines"), F.sum("code").alias("code"), F.sum("comment").alias("comments"), F.sum("blank").alias("blanks"), F.sum("complexity").alias("complexity"), F.sum("bytes").alias("bytes"))
    return told.groupBy(by).agg(F.count(F.lit(1)).alias("files"), *sums)


def _declared(line: Column) -> Column:
    return reduce(lambda a, r: F.coalesce(a, F.when(F.regexp_extract(line, r[1], 1) != "", F.struct(F.lit(r[0]).alias("kind"), F.regexp_extract(line, r[1], 1).alias("name")))), DECLARATIONS, F.lit(None).cast("struct<kind: string, name: string>"))


def _braces(line: Column) -> Column:
    """Struct of the braces that a line closes and of those that it leaves open."""
    start = F.struct(F.lit(0).alias("closed"), F.lit(0).alias("open"))
    step = lambda s, c: F.struct(
        (s["closed"] + F.when((c == "}") & (s["open"] == 0), 1).otherwise(0)).alias("closed"),
        (s["open"] + F.when(c == "{", 1).when(s["open"] > 0, -1).otherwise(0)).alias("open"),
    )
    return F.aggregate(F.filter(F.split(F.regexp_replace(line, "[^{}]", ""), ""), lambda c: c != ""), start, step)


def _indent(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, "^[ \\t]*", 0), "\\t", "        "))


def scoped_symbols(files: DataFrame, key: str, ext: str = "ext") -> DataFrame:
    """(key, ext, line_no, kind, name, scope, signature) of the declarations in (key, ext, text), one row of ``files`` a key.

    scope: the names of all declarations around it, the outermost first, joined by a point, null outside of all;
    a function in a class or an implementation is a method. signature: parameters and result, in one line, though it may
    stand on ``AHEAD`` lines; null without. Declarations in comments and strings are none.
    """
    python = F.col("ext") == "py"
    rows = files.select(F.col(key).alias("key"), F.col(ext).alias("ext"), F.split(masked(F.col("text"), F.col(ext)), "\n").alias("m"))
    ahead = lambda x, i: F.when(x.rlike(_ANY), F.array_join(F.slice(F.col("m"), i + 1, F.lit(AHEAD)), "\n"))
    levels = F.array_distinct(F.transform(F.filter("m", lambda x: python & x.rlike(_ANY)), lambda x: _indent(x)))
    rows = rows.select("key", "ext", levels.alias("levels"), F.transform("m", lambda x, i: F.struct(x.alias("line"), ahead(x, i).alias("ahead"))).alias("l"))
    rows = rows.select("key", "ext", "levels", F.posexplode("l").alias("at", "l")).select("key", "ext", "levels", (F.col("at") + 1).alias("line_no"), "l.*")
    rows = rows.where(line_kind(F.col("line")) == "code")
    order = Window.partitionBy("key").orderBy("line_no")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    brackets = F.regexp_count("line", F.lit("[(\\[{]")) - F.regexp_count("line", F.lit("[)\\]}]"))
    inner = F.coalesce(F.sum(brackets).over(earlier), F.lit(0)) > 0
    rows = rows.withColumn("inner", inner).where(~python | ~(F.col("inner") | F.col("line").startswith(GOES_ON)))  # lines that only go on have no indentation
    rows = rows.withColumn("b", _braces(F.col("line"))).withColumn("indent", _indent(F.col("line")))
    depth = F.coalesce(F.sum(F.col("b.open") - F.col("b.closed")).over(earlier), F.lit(0)).cast("int")
    rows = rows.withColumn("before", F.when(python, F.coalesce(F.lag("indent").over(order), F.lit(0))).otherwise(depth))
    rows = rows.withColumn("low", F.when(python, F.col("indent")).otherwise(F.col("before") - F.col("b.closed")))
    between = F.when(python, F.filter("levels", lambda x: (x >= F.col("low")) & (x < F.col("before")))).when(F.col("before") > F.col("low"), F.sequence("low", F.col("before") - 1))
    closings = rows.select("key", "line_no", F.explode(between).alias("level"))
    found = rows.withColumn("d", _declared(F.col("line"))).where("d IS NOT NULL")
    body = python | F.col("ahead").rlike("^[^;{]*\\{")
    inside = python | (F.col("before") - F.col("b.closed") + F.col("b.open") > F.col("low")) | ~F.col("line").contains("{")
    signature = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("ahead", _PARAMETERS, 1), f"[{STRING}{GOES_ON}]+", '""'), f"[\\s{COMMENT}]+", " "))
    found = found.select("key", "ext", "levels", "line_no", "low", "d.kind", "d.name", (body & inside).alias("holds"), F.nullif(signature, F.lit("")).alias("signature"))
    nothing = F.lit(None)
    opened = found.where("holds").select("key", F.col("low").alias("level"), "line_no", F.lit(1).alias("what"), F.struct("name", "kind").alias("owner"))
    ends = closings.select("key", "level", "line_no", F.lit(0).alias("what"), nothing.cast("struct<name: string, kind: string>").alias("owner"))
    events = Window.partitionBy("key", "level").orderBy("line_no", "what")
    after = events.rowsBetween(1, Window.unboundedFollowing)
    spans = opened.unionByName(ends).withColumn("end", F.min(F.when(F.col("what") == 0, F.col("line_no"))).over(after)).where("what = 1")
    around = F.when(python, F.filter("levels", lambda x: x < F.col("low"))).when(F.col("low") > 0, F.sequence(F.lit(0), F.col("low") - 1))
    asked = found.select("key", "line_no", F.explode(around).alias("level"), F.lit(0).alias("what"))
    asked = asked.withColumn("owner", nothing.cast("struct<name: string, kind: string>")).withColumn("end", nothing.cast("int"))
    last = F.last(F.when(F.col("what") == 1, F.struct("owner", "end")), ignorenulls=True).over(events.rowsBetween(Window.unboundedPreceding, -1))
    met = asked.unionByName(spans).withColumn("x", last).where("what = 0 AND x IS NOT NULL AND (x.end IS NULL OR x.end > line_no)")
    scopes = met.groupBy("key", "line_no").agg(F.array_sort(F.collect_list(F.struct("level", "x.owner"))).alias("s"))
    scopes = scopes.select("key", "line_no", F.array_join(F.transform("s", lambda x: x["owner"]["name"]), ".").alias("scope"), F.element_at("s", -1)["owner"]["kind"].alias("within"))
    out = found.join(scopes, ["key", "line_no"], "left")
    kind = F.when((F.col("kind") == "function") & F.col("within").isin("class", "implementation"), "method").otherwise(F.col("kind"))
    return out.select(F.col("key").alias(key), "ext", "line_no", kind.alias("kind"), "name", "scope", "signature")
