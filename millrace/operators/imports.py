"""What source files import, in order and once each, comments over lines left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QUOTES = "[\"'`]"


def _one(line: Column, rule: str, internal) -> Column:
    """What the first group finds, as an array of at most one (target, internal)."""
    target = F.trim(F.regexp_extract(line, rule, 1))
    return F.when(target != "", F.array(F.struct(target.alias("target"), internal(target).alias("internal"))))


def _stripped(target: Column, marks: str) -> Column:
    return F.regexp_replace(F.trim(target), f"^{marks}+|{marks}+$", "")


def _listed(targets: Column, internal) -> Column:
    return F.transform(F.filter(targets, lambda t: t != ""), lambda t: F.struct(t.alias("target"), internal(t).alias("internal")))


def imported(ext: Column, line: Column) -> Column:
    """Array of (target, internal) of one trimmed line; null without any."""
    never, local = (lambda t: F.lit(False)), (lambda t: t.startswith(".") | t.startswith("/"))
    dotted = lambda t: t.startswith(".")
    crate = lambda t: t.startswith("crate::") | t.startswith("self::") | t.startswith("super::")
    names = F.transform(F.split(F.regexp_extract(line, "^import (.*)", 1), ","), lambda p: F.regexp_extract(p, "^\\s*(\\S*)", 1))
    module = _stripped(F.regexp_replace(F.regexp_extract(line, "^(?:import|export) .*from (.*)", 1), "[;\\s]+$", ""), _QUOTES)
    required = _stripped(F.regexp_extract(line, "require\\(([^)]*)\\)", 1), _QUOTES)
    path = _stripped(F.regexp_replace(F.regexp_extract(line, "^import (.*)", 1), "^\\s*\\(+", ""), "[\"`)]")
    gem = _stripped(F.regexp_extract(line, "^require (.*)", 1), "[\"']")
    return (
        F.when(ext == "rs", F.coalesce(_one(line, "^use ([^;]*);", crate), _one(line, "^extern crate ([^;]*);", never)))
        .when(ext == "py", F.coalesce(_one(line, "^from (.*?) import", dotted), F.when(line.startswith("import "), _listed(names, never))))
        .when(ext.isin("js", "jsx", "ts", "tsx", "vue", "svelte"), _listed(F.array(module, required), local))
        .when(ext.isin("java", "kt", "kts", "scala"), _one(line, "^import ([^;]*);", never))
        .when(ext.isin("c", "h", "cpp", "hpp", "cc", "cxx"), F.coalesce(_one(line, "^#include\\s*<([^>]*)>", never), _one(line, "^#include\\s*\"([^\"]*)\"", lambda t: F.lit(True))))
        .when(ext == "cs", _one(line, "^using ([^;]*);", never))
        .when(ext == "go", _listed(F.array(path), lambda t: ~F.substring_index(t, "/", 1).contains(".")))
        .when(ext == "rb", _listed(F.array(gem), dotted))
    )


def ordered_imports(files: DataFrame, key: str, ext: str = "ext") -> DataFrame:
    """(key, internal, external) of (key, ext, text), one row of ``files`` a key: distinct targets in the order of their first place.

    Lines that begin with // or * are left out, and so is a block comment that begins a line and does not end there, up to
    and with the line that ends it. Whether a line is inside follows from the last line before it that opens or ends one.
    """
    rows = files.select(F.col(key).alias("key"), F.lower(F.col(ext)).alias("ext"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r?\\n")).alias("at", "line"))
    line = F.trim(F.regexp_replace("line", "\\t", " "))
    rows = rows.withColumn("line", line)
    ends = F.col("line").contains("*/")
    marks = F.when(ends, False).when(F.col("line").startswith("/*"), True)
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.last(marks, ignorenulls=True).over(before), F.lit(False)))
    skipped = F.col("inside") | (F.col("line").startswith("/*") & ~ends) | F.col("line").startswith("//") | F.col("line").startswith("*")
    found = rows.where(~skipped).select("key", "at", F.posexplode(imported(F.col("ext"), F.col("line"))).alias("nth", "i"))
    first = found.groupBy("key", "i.target", "i.internal").agg(F.min(F.struct("at", "nth")).alias("place"))
    listed = lambda inner: F.transform(F.array_sort(F.collect_list(F.when(F.col("internal") == inner, F.struct("place", "target")))), lambda x: x["target"])
    out = first.groupBy("key").agg(listed(True).alias("internal"), listed(False).alias("external"))
    return out.withColumnRenamed("key", key)
