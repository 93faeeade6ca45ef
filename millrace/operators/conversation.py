"""Turns of conversations: grouping, retention, compaction, search text. Messages: conv_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def size(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint")


def grouped(messages: DataFrame) -> DataFrame:
    """Adds turn_no (from 1) to all but system messages.

    A user message opens a turn, other messages join the open one; before the first user message each is a turn.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    opens = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order)
    rows = messages.where("role <> 'system'").withColumn("opened", opens)
    starts = (F.col("role") == "user") | (F.col("opened") == 0)
    return rows.withColumn("turn_no", F.sum(F.when(starts, 1).otherwise(0)).over(order)).drop("opened")


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn_no, n_messages, bytes, by_user)."""
    return grouped(messages).groupBy("conv_id", "turn_no").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.sum(size(F.col("text"))).alias("bytes"),
        F.max(F.col("role") == "user").alias("by_user"),
    )


def retained(turns: DataFrame, prefix: int, tail: int, budget: int) -> DataFrame:
    """Adds slot: prefix for the first user turns, tail for the newest that fit count and bytes; the newest always stays.

    Trimming at every push removes from the front only, and sums of the newest turns only grow: what fits at the end
    has always fitted, so two running windows say what a replay would.
    """
    order = Window.partitionBy("conv_id").orderBy("turn_no")
    pinned = F.col("by_user") & (F.sum(F.when(F.col("by_user"), 1).otherwise(0)).over(order) <= prefix)
    rows = turns.withColumn("pinned", pinned)
    newest = Window.partitionBy("conv_id", "pinned").orderBy(F.desc("turn_no"))
    rows = rows.withColumn("rn", F.row_number().over(newest)).withColumn("cum", F.sum("bytes").over(newest))
    stays = (F.col("rn") == 1) | ((F.col("rn") <= tail) & (F.col("cum") <= budget))
    return rows.withColumn("slot", F.when(F.col("pinned"), "prefix").when(stays, "tail")).where("slot IS NOT NULL").drop("pinned", "rn", "cum")


def compacted(role: Column, text: Column, most: int) -> Column:
    """Long contents (over ``most`` bytes) of the role that reports results become a note with their size."""
    note = F.concat(F.lit("[compacted "), size(text).cast("string"), F.lit(" bytes]"))
    return F.when((role == "assistant") & (size(text) > most), note).otherwise(text)


def search_text(messages: DataFrame) -> DataFrame:
    """(conv_id, short, full): user messages of the last turn; before them the last answer of the turns before."""
    rows = grouped(messages)
    last = Window.partitionBy("conv_id")
    rows = rows.withColumn("last_no", F.max("turn_no").over(last))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "\n\n")
    user = F.when((F.col("turn_no") == F.col("last_no")) & (F.col("role") == "user"), F.struct("turn", "text"))
    answer = F.when((F.col("turn_no") < F.col("last_no")) & (F.col("role") == "assistant") & (F.trim("text") != ""), F.struct("turn", "text"))
    out = rows.groupBy("conv_id").agg(listed(user).alias("short"), F.max(answer)["text"].alias("answer"))
    return out.select("conv_id", "short", F.concat_ws("\n\n", "answer", F.when(F.col("short") != "", F.col("short"))).alias("full"))


USAGE = "prompt_tokens bigint, completion_tokens bigint, cost decimal(18,6), completion_tokens_details struct<reasoning_tokens: bigint>"


def usage_totals(records: DataFrame, key: str, usage: str = "usage") -> DataFrame:
    """(key, calls, prompt_tokens, completion_tokens, reasoning_tokens, cost) of JSON usage records.

    Each record is one call. A missing cost, detail or token count adds 0; rows without a record (null) are no calls.
    """
    rows = records.where(F.col(usage).isNotNull()).select(key, F.from_json(usage, USAGE).alias("u"))
    total = lambda c: F.coalesce(F.sum(f"u.{c}"), F.lit(0))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("calls"),
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("completion_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        total("cost").cast("double").alias("cost"),
    )


def compaction_verdicts(originals: DataFrame, proposals: DataFrame) -> DataFrame:
    """(conv_id, before, after, verdict) of proposed shorter forms (conv_id, role, text, one row a message) of conversations.

    Refused, in this order: empty (no message), role (one that isn't user or assistant), size (bytes are not less);
    else accepted. A null text has no bytes. Proposals for conversations that aren't there have no row.
    """
    before = originals.groupBy("conv_id").agg(F.sum(size(F.col("text"))).alias("before"))
    fine = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    after = proposals.groupBy("conv_id").agg(F.sum(size(F.col("text"))).alias("after"), F.min(fine).alias("roles"))
    rows = before.join(after, "conv_id", "left")
    verdict = F.when(F.col("after").isNull(), "empty").when(~F.col("roles"), "role").when(F.col("after") >= F.col("before"), "size").otherwise("accepted")
    return rows.select("conv_id", "before", "after", verdict.alias("verdict"))
