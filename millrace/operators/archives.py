"""Nested archives of conversations: turns that stand for older ones, which may be archives themselves.

Turns are a forest (conv_id, turn, parent, place, archived): a null parent is a turn in the open, place orders the
turns of one archive, archived says whether the turn stands for others (perhaps none). All that is asked of a tree
is a sum, over descendants or over ancestors, and is found by pointer doubling: after k rounds a turn knows its
ancestor 2^k up and the sums on the way there, so a tree of depth d takes log2(d) rounds, each a join by key.
A row is a fixed number of bytes in every round, however deep it lies. A parent that isn't there ends the way up.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.shared import written
from millrace.operators.running import running

KEY = ["conv_id", "turn"]


def _up(nodes: DataFrame) -> DataFrame:
    return nodes.select("conv_id", F.col("turn").alias("jump"), F.col("jump").alias("next"), F.col("sum").alias("sum_up"))


def _rounds(rows: DataFrame) -> Iterator[int]:
    """As many rounds as any tree can take; none for turns that all are in the open."""
    if rows.where("jump IS NOT NULL").take(1):
        yield from range(rows.count().bit_length() + 1)
        raise ValueError("turns that are inside themselves")


def over_ancestors(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, sum): own values (conv_id, turn, parent, value) and those of all turns around it."""
    rows = written(nodes.select(*KEY, F.col("parent").alias("jump"), F.col("value").cast("bigint").alias("sum")), "up")
    for _ in _rounds(rows):
        done = rows.where("jump IS NULL")
        moved = rows.where("jump IS NOT NULL").join(_up(rows), ["conv_id", "jump"], "left")
        rows = written(done.unionByName(moved.select(*KEY, F.col("next").alias("jump"), (F.col("sum") + F.coalesce("sum_up", F.lit(0))).alias("sum"))), "up")
        if not rows.where("jump IS NOT NULL").take(1):
            break
    return rows.select(*KEY, "sum")


def over_descendants(nodes: DataFrame) -> DataFrame:
    """(conv_id, turn, sum): own values and those of all turns inside it."""
    rows = written(nodes.select(*KEY, F.col("parent").alias("jump"), F.col("value").cast("bigint").alias("sum")), "down")
    for _ in _rounds(rows):
        inside = rows.where("jump IS NOT NULL").groupBy("conv_id", F.col("jump").alias("turn")).agg(F.sum("sum").alias("more"))
        next_ = rows.where("jump IS NOT NULL").join(_up(rows).drop("sum_up"), ["conv_id", "jump"]).select(*KEY, F.col("next").alias("jump_"))
        both = rows.join(inside, KEY, "left").join(next_, KEY, "left")
        rows = written(both.select(*KEY, F.col("jump_").alias("jump"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum")), "down")
        if not rows.where("jump IS NOT NULL").take(1):
            break
    return rows.select(*KEY, "sum")


def archive_len(nodes: DataFrame) -> DataFrame:
    """(conv_id, hidden, depth): how many turns are inside others, and how deep."""
    depth = over_ancestors(nodes.withColumn("value", F.when(F.col("parent").isNull(), 0).otherwise(1)))
    hidden = F.sum(F.when(F.col("sum") > 0, 1).otherwise(0))
    return depth.groupBy("conv_id").agg(hidden.alias("hidden"), F.max("sum").alias("depth"))


def unfreeze_all(nodes: DataFrame) -> DataFrame:
    """(conv_id, place, turn, restored): the turns in the open when all archives are opened; restored ones were inside.

    Turns that stand for nothing stay, in depth-first order; an empty archive leaves no turn. A turn's place is the
    number of staying turns before it: in earlier turns of its archive, and of each archive around it.
    """
    nodes = written(nodes.select(*KEY, "parent", "place", "archived"), "forest")
    stays = F.when(F.col("archived"), 0).otherwise(1)
    inside = over_descendants(nodes.withColumn("value", stays)).withColumnRenamed("sum", "leaves")
    sized = nodes.join(inside, KEY)
    before = running(sized, ["conv_id", "parent"], ["place", "turn"], {"upto": F.col("leaves")})
    at = over_ancestors(before.withColumn("value", F.col("upto") - F.col("leaves"))).withColumnRenamed("sum", "place")
    leaves = nodes.where(~F.col("archived")).select(*KEY, F.col("parent").isNotNull().alias("restored"))
    return leaves.join(at, KEY).select("conv_id", "place", "turn", "restored")


def unfreeze_last(nodes: DataFrame) -> DataFrame:
    """(conv_id, place, turn, restored): the turns in the open when the last archive among them is opened by one level.

    Others keep their order; without an archive nothing changes.
    """
    top = nodes.where("parent IS NULL")
    last = top.where("archived").groupBy("conv_id").agg(F.max(F.struct("place", "turn")).alias("last"))
    rows = nodes.join(last, "conv_id", "left")
    inner = F.coalesce(F.col("parent") == F.col("last.turn"), F.lit(False))
    opened = F.coalesce(F.col("parent").isNull() & (F.col("turn") == F.col("last.turn")), F.lit(False))
    rows = rows.where((F.col("parent").isNull() & ~opened) | inner)
    outer = F.when(inner, F.struct(F.col("last.place").alias("place"), F.col("last.turn").alias("turn"))).otherwise(F.struct(F.col("place").alias("place"), F.col("turn").alias("turn")))
    rows = rows.select("conv_id", "turn", inner.alias("restored"), outer.alias("o"), F.when(inner, F.col("place")).alias("i"))
    rows = rows.select("conv_id", "turn", "restored", F.col("o.place").alias("o_place"), F.col("o.turn").alias("o_turn"), "i")
    placed = running(rows, ["conv_id"], ["o_place", "o_turn", "i", "turn"], {"nth": F.lit(1)})
    return placed.select("conv_id", (F.col("nth") - 1).cast("bigint").alias("place"), "turn", "restored")
