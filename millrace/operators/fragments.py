"""Calls that arrive in fragments (stream, seq, idx, id, name, arguments, last): put together by index, in order of seq.

seq counts from 0 within a stream; the fragment marked last says how many there are, and none has a higher number. Any order and repeated fragments
do. A call's id is the last that isn't empty; names and arguments are joined; null pieces are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CALL = "stream string, idx bigint, id string, name string, arguments string"


def assembled(fragments: DataFrame) -> DataFrame:
    """(stream, idx, id, name, arguments) of the streams that are whole."""
    rows = fragments.groupBy("stream", "seq").agg(F.min(F.struct("idx", "id", "name", "arguments")).alias("f"), F.max("last").alias("last"))
    whole = rows.groupBy("stream").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("last"), F.col("seq"))).alias("end"), F.max("seq").alias("top")).where("n = end + 1 AND top = end")
    rows = rows.join(whole.select("stream"), "stream", "left_semi").where("f.idx IS NOT NULL")
    piece = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", piece(c).alias("x")))), lambda p: p["x"]), "")
    named = F.max(F.when(piece("id") != "", F.struct("seq", piece("id").alias("id"))))["id"]
    return rows.groupBy("stream", F.col("f.idx").cast("bigint").alias("idx")).agg(F.coalesce(named, F.lit("")).alias("id"), joined("name").alias("name"), joined("arguments").alias("arguments"))
