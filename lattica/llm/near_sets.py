"""Near copies by their shingle sets.

A document is the set of its five-word shingles (lower case; fewer words are one shingle), as 64-bit hashes. Documents of
equal sets are one class. Candidates between classes come from minima: for each of ``BANDS * ROWS`` permutations of the
hashes, two sets of similarity ``j`` have the same minimum with probability ``j``, so that ``ROWS`` minima in a row, a band,
are equal with ``j ** ROWS``. Two sets of similarity 0.8 have no band in common in one of 40,000 cases (``(1 - 0.8 ** 4) ** 20``),
sets that share a passage only hardly ever have one. What meets in a band is verified on the whole sets, and no more of it than
is needed to know whether a document has an earlier one.

A document goes if one with a smaller doc_id has the similarity with it. All are judged on the input. Hashing is done in Python,
once for fingerprint and minima and again for the sets of those that meet; the joins are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import marked, materialise, spread_join, text_key
from lattica.llm.shingles import fingerprint, shingle_hashes

BANDS, ROWS = 20, 4
LAST = (1 << 63) - 1


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), seed) for i in range(n)], np.uint64)


FLIP, ODD, MIX = numbers(BANDS * ROWS, 1), numbers(BANDS * ROWS, 2) | np.uint64(1), numbers(ROWS, 3) | np.uint64(1)


def bands(h: np.ndarray) -> np.ndarray:
    """A number per band of a set of hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1024):  # bounded memory for very long texts
        np.minimum(low, ((h[i : i + 1024, None] ^ FLIP) * ODD).min(axis=0), out=low)
    return (low.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint), id (of the set), n (its size; 0 without a word) and keys (its bands) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps, ids, sizes, keys = [], [], [], []
            for text in frame["text"]:
                h = shingle_hashes(text, width)
                fps.append(fingerprint(h))
                h = np.unique(h)
                ids.append(xxhash.xxh3_64_intdigest(h.tobytes()))
                sizes.append(len(h))
                keys.append(bands(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_key": frame["text_key"], "fp": signed(fps), "id": signed(ids), "n": np.array(sizes, np.int32), "keys": keys})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInPandas(run, "doc_id long, text_key long, fp long, id long, n int, keys array<long>")


def place() -> Column:
    """What orders documents; a null doc_id is last."""
    return F.coalesce("doc_id", F.lit(LAST))


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, first, w: the shingle sets, 32 bits each, of the rows wanted (text_key, id, first)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [np.unique(np.unique(shingle_hashes(t, width)).astype(np.uint32)).view(np.int32) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["id"], "first": frame["first"], "w": sets})

    rows = docs.select(place().cast("long").alias("first"), text_key(F.col("text")).alias("text_key"), "text")
    held = marked(rows, "text_key", wanted.select("text_key")).join(wanted, ["first", "text_key"])
    return held.select("id", "first", "text").mapInPandas(run, "id long, first long, w array<int>").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """id of the classes b of pairs (a: a first, b: an id) that have the similarity with their a."""
    a, b = sets.select(F.col("first").alias("a"), F.col("w").alias("wa")), sets.select(F.col("id").alias("b"), F.col("w").alias("wb"))
    both = pairs.join(a, "a").join(b, "b")
    near = F.least(F.size("wa"), F.size("wb")) >= similarity * F.greatest(F.size("wa"), F.size("wb")) - 1e-9
    both = both.where(near).withColumn("shared", F.size(F.array_intersect("wa", "wb")))
    return both.where(F.col("shared") >= similarity * (F.size("wa") + F.size("wb") - F.col("shared")) - 1e-9).select(F.col("b").alias("id")).distinct()


def late_rows(marks: DataFrame, docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_key of the rows (marks: written sketches of docs) for which a smaller doc_id has a text of at least the similarity; each once.

    Whether there is one is asked, not which: each class meets the earliest class of its bands first, the one of most bands, so
    that of a large group of variants nearly all are settled by a pair each. Only those that are left meet all earlier ones.
    """
    rows = marks.where("n > 0")
    grouped = rows.groupBy("id", "n", "keys").agg(F.min(F.struct(place().alias("first"), "text_key")).alias("of"), F.count(F.lit(1)).alias("rows"))
    classes = materialise(grouped.select("id", "n", "keys", "of.*", "rows"), "near-classes")
    posts = classes.select(F.explode("keys").alias("key"), "id", "n", "first")
    heads = materialise(posts.groupBy("key").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-heads")
    met = materialise(spread_join(posts, heads, "key"), "near-postings")
    sets = materialise(sets_of(docs, classes.select("text_key", "id", "first").join(met.select("id").distinct(), "id", "left_semi"), width), "near-sets")
    led = met.where("first > lead").groupBy("id", "lead").agg(F.count(F.lit(1)).alias("c"))
    tried = materialise(led.groupBy(F.col("id").alias("b")).agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("a")), "near-pairs")
    late = materialise(verified(tried, sets, similarity), "near-late")
    left = met.join(late, "id", "left_anti")
    size = (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9) & (F.col("x.first") < F.col("y.first")) & (F.col("x.id") != F.col("y.id"))
    rest = met.alias("x").join(left.alias("y"), (F.col("x.key") == F.col("y.key")) & size).select(F.col("x.first").alias("a"), F.col("y.id").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    late = late.unionByName(verified(rest, sets, similarity)).distinct().withColumn("late", F.lit(True))
    known = materialise(classes.select("id", "first", "rows").join(late, "id", "left").where("late OR rows > 1"), "near-known")
    told = spread_join(rows.select("doc_id", "text_key", "id"), known, "id")
    return told.where(F.coalesce("late", F.lit(False)) | (place() > F.col("first"))).select("doc_id", "text_key").distinct()
