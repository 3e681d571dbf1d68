"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant at most r bits from either. So each distinct fingerprint
emits its ball (itself and all variants within half the radius), variants meet in a shuffle, and whoever meets is
verified by the differing bits. Copies of a text share a fingerprint and enter once. A variant's members all lie in the
ball around it, so a group has at most ``1 + 64`` members (for radius 2) however many rows there are, and each member is
linked with the group's smallest only: for even radii every two members of a group are within the radius of each other.

Fingerprints reach no further than a few changed words. ``keep_one`` therefore also compares shingle sets (``near_sets``).

Links become components by alternating large-star and small-star steps, each written to the shared folder. Neither links
nor fingerprints ever come to the driver, only a count a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import as_rows, materialise, spread_join, text_key
from lattica.llm.near_sets import late_rows, sketches
from lattica.llm.shingles import BITS, fingerprint, shingle_hashes


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(shingle_hashes(t, width)) for t in frame["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": fps})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """The masks of at most radius bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """a, b: verified links between distinct fingerprints (column fp) at most radius bits apart, enough to join what belongs together.

    radius has to be even: then members of a group may all be linked with its smallest.
    """
    if radius % 2:
        raise ValueError("the radius has to be even")
    met = fps.select("fp", F.explode(F.array(*map(F.lit, ball(radius // 2)))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    pairs = met.select("fp", least.alias("a")).where("fp <> a").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= radius)
    return pairs.select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: for every node of the edges (a, b) the smallest node that it reaches."""
    edges = materialise(edges, "edges")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    now = mark(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour, or to the node itself
        near = both(edges)
        low = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = near.where("b > a").join(low, "a").select(F.col("low").alias("a"), "b").where("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of these
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("low").alias("a"), "b"), F.struct(F.col("low").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        after = materialise(small, "edges")
        edges, was, now = after, now, mark(after)
        if was == now:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def with_components(marks: DataFrame, radius: int) -> DataFrame:
    """marks (written; doc_id, fp and others) with component_id; the rows of a fingerprint of very many copies aren't gathered."""
    least = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "classes")
    roots = components(links(least.select("fp"), radius))
    of = least.join(roots, least.fp == roots.node, "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return spread_join(marks, materialise(of.join(ids, "root").select("fp", "rows", "component_id"), "components"), "fp")


def simhash_components(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id.

    Defined cases: a null or wordless text has fingerprint zero, linked like any other; a null doc_id counts as larger
    than any other (component_id is null only where a component has no other); repeated rows share a component; an
    empty table gives no rows; other columns are ignored.
    """
    told = with_components(materialise(fingerprints(docs, width), "fingerprints"), radius)
    return told.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 5, radius: int = 2, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, of the document with the smallest doc_id in each component, without those
    whose shingle sets have the similarity with a smaller doc_id's: fingerprints alone miss most edited copies.

    Defined cases: texts without a word are a component of their own kind (fingerprint zero); rows that repeat doc_id and text
    are judged alike, and of rows that share a doc_id and differ in text each is judged by its own; a null doc_id counts as larger than
    any other; an empty table gives no rows; other columns stay, whatever their names.
    """
    marks = materialise(sketches(docs, width), "sketches")
    late = late_rows(marks, docs, width, similarity)
    first = with_components(marks.select("doc_id", "text_key", "fp"), radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_key").distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])
    kept = materialise(first.join(late, same(first, late), "left_anti"), "kept")
    rows = as_rows(docs)
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(kept["doc_id"]) & (text_key(F.col("row.text")) == kept["text_key"]), "left_semi").select("row.*")
