"""Exact dedup by a heavy-hitter split.

1. Every text is normalised and digested once (SHA-256); the digests, not the texts, go on.
2. A Misra-Gries summary (the frequent-items sketch behind ``approx_top_k``) over all digests names the candidates for
   frequent digests. It holds a fixed number of counters, merges by partition, and misses no digest that makes up more
   than about ``1 / counters`` of the rows.
3. The candidates are counted exactly, with partial sums before the shuffle; those verified as frequent are the winners,
   with the smallest id of each. There are at most ``top`` of them, so they are broadcast, and rows of frequent digests
   are decided where they are read, without a shuffle.
4. The remaining digests are grouped by an ordinary shuffle, with partial sums before it, and joined back to their rows. A group there
   can still be of many rows (one of more than ``top`` frequent digests); none is gathered in one place, and the join of one can be split.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import SPACES, materialise


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 of the text after each run of white space has become one space; null counts as empty."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    return docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("text_sha256"))


def frequent(marks: DataFrame, top: int, counters: int, at_least: int) -> DataFrame:
    """The verified winners: text_sha256, keep_id, group_size of the digests that at_least rows share, at most top of them."""
    found = marks.agg(F.expr(f"approx_top_k(text_sha256, {top}, {counters})").alias("x")).select(F.explode("x").alias("x"))
    names = found.where(F.col("x.count") >= at_least).select(F.col("x.item").alias("text_sha256"))
    counted = marks.join(F.broadcast(names), "text_sha256", "left_semi").groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return counted.where(F.col("group_size") >= at_least)


def exact_dedup(docs: DataFrame, top: int = 1024, counters: int = 16384, at_least: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal normalised texts the one with the smallest doc_id stays (``kept``). Defined cases: a null text is
    empty; a null doc_id never stays unless its group has no other, and then keep_id is null and kept true; rows that
    repeat doc_id and text are one document, and all of them carry the same verdict; an empty table gives no rows; other
    columns are ignored, whatever their names.
    """
    marks = materialise(digests(docs), "digests")
    winners = materialise(frequent(marks, top, counters, at_least), "frequent")
    hot = marks.join(F.broadcast(winners), "text_sha256")
    rest = marks.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    cold = rest.join(groups, "text_sha256")
    columns = ("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return cold.select(*columns).unionByName(hot.select(*columns))
