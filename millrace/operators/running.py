"""Running sums and numbered parts over keys of any size: ranges, totals of ranges, sums within ranges.

Rows are dealt by ranges of (key, order), so a key with a third of all rows lies in a third of the ranges. A window
runs within each range of a key; what stands before a range comes from the totals of the key's ranges, of which
there are as many as partitions at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.shared import written


def ranges(rows: DataFrame, by: list[str], order: list[str], pieces: int | None = None) -> DataFrame:
    """Adds piece: the number of the range of (by, order) that holds the row; equal ones share one. The table is written, so that pieces stay what they are."""
    n = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(n, *by, *order).withColumn("piece", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], pieces: int | None = None) -> DataFrame:
    """Adds for each name the sum of its column over the rows of the same key up to and with this one, in ``order``.

    ``order`` must tell the rows of a key apart; null sums count 0; null keys are a key of their own. ``piece`` and
    names that start with ``sum_`` must be free.
    """
    names = list(sums)
    dealt = ranges(rows.select("*", *(F.coalesce(c, F.lit(0)).alias(f"sum_{n}") for n, c in sums.items())), by, order, pieces)
    totals = dealt.groupBy(*by, "piece").agg(*(F.sum(f"sum_{n}").alias(f"sum_{n}") for n in names))
    earlier = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    kept = [F.col(c).alias(f"sum_{c}") for c in by]
    before = totals.select(*kept, F.col("piece").alias("sum_piece"), *(F.coalesce(F.sum(f"sum_{n}").over(earlier), F.lit(0)).alias(f"sum_before_{n}") for n in names))
    inside = Window.partitionBy(*by, "piece").orderBy(*order)
    local = dealt.select("*", *(F.sum(f"sum_{n}").over(inside).alias(n) for n in names)).drop(*(f"sum_{n}" for n in names))
    same = F.col("piece") == F.col("sum_piece")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"sum_{c}"))
    out = local.join(before, same, "left")
    return out.select(*rows.columns, *((F.col(n) + F.col(f"sum_before_{n}")).alias(n) for n in names))


def parts(rows: DataFrame, by: list[str], order: list[str], item: Column, size: int, pieces: int | None = None) -> DataFrame:
    """(by, part, items): the items of each key in order, in numbered parts of ``size`` at most: what a nested value of a key of any size becomes."""
    placed = running(rows.select(*by, *order, item.alias("item_")), by, order, {"place_": F.lit(1)}, pieces)
    numbered = placed.withColumn("part", F.floor((F.col("place_") - 1) / size))
    listed = numbered.groupBy(*by, "part").agg(F.array_sort(F.collect_list(F.struct("place_", "item_"))).alias("l"))
    return listed.select(*by, "part", F.transform("l", lambda x: x["item_"]).alias("items"))
