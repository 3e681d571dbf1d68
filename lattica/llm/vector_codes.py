"""Vector code compression: product quantisation in whole numbers.

Vectors are written once as blocks: a row of a Parquet table holds a few thousand vectors, component by component. Each round is an RDD
treeAggregate over the blocks. A task accumulates the distances to a codebook's entries dimension by dimension, takes the nearest, and adds
the parts to int64 tensors of sums and counts with np.add.at; the tensors, of fixed size, merge through a tree of tasks. Blocks are read from
the shared folder, so a lost executor costs its tasks, and all sums are of whole numbers, so a repeated task changes nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialise, spread_join

PARTS, ENTRIES, SCALE = 4, 256, 1024
#: Vectors of a block, and of a tile whose distances are held at once.
BLOCK, TILE = 4096, 512


class Codebook(NamedTuple):
    entries: np.ndarray  # part, entry, component; int64

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def bound(width: int) -> int:
    """The largest component with which a distance over all parts fits in 63 bits."""
    return math.isqrt((2**63 - 1) // max(1, PARTS * width)) // 2


def scaled(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Components (PARTS * width) by vectors, int64: floor(1024 * x), zeros behind a shorter vector, not beyond the bound."""
    out = np.zeros((PARTS * width, len(vectors)), np.int64)
    most = bound(width)
    for i, v in enumerate(vectors):
        out[: len(v), i] = np.clip(np.floor(v.astype(np.float64) * SCALE), -most, most)
    return out


def blocks(vectors: DataFrame, width: int) -> DataFrame:
    """ids, labels, data: the rows of vectors (id, label, embedding) in blocks of at most BLOCK; data is their components as little-endian int64."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                column = part.column(2)
                lengths = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False)
                data = scaled(np.split(flat, np.cumsum(lengths)[:-1]), width) if part.num_rows else np.zeros((PARTS * width, 0), np.int64)
                yield pa.RecordBatch.from_pydict({"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "labels": pa.array([part.column(1).to_pylist()], pa.list_(pa.string())), "data": pa.array([data.astype("<i8").tobytes()], pa.binary())})

    return vectors.mapInArrow(run, "ids array<long>, labels array<string>, data binary")


def columns(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(PARTS * width, -1) if width else np.zeros((0, 0), np.int64)


def nearest(data: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the columns of data (component, vector) the nearest of entries (entry, component), the first of ties, and its squared distance."""
    n = data.shape[1]
    code, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    small = len(data) * (2 * max(np.abs(data).max(initial=0), np.abs(entries).max(initial=0), 1)) ** 2 < 2**31
    kind = np.int32 if small else np.int64
    x, c = np.ascontiguousarray(data, kind), np.ascontiguousarray(entries.T, kind)
    gap = np.empty((min(n, TILE), len(entries)), kind)
    for at in range(0, n, TILE):
        size = min(TILE, n - at)
        distance, g = np.zeros((size, len(entries)), kind), gap[:size]
        for d in range(len(x)):
            np.subtract(x[d, at : at + size, None], c[d], out=g)
            np.multiply(g, g, out=g)
            distance += g
        code[at : at + size] = distance.argmin(axis=1)
        error[at : at + size] = distance[np.arange(size), code[at : at + size]]
    return code, error


def improved(book: Codebook, written: DataFrame, depth: int) -> Codebook:
    """A round: every entry becomes the floor of its parts' mean, component by component; one without parts stays."""
    context, width = written.sparkSession.sparkContext, book.width
    shared = context.broadcast(book.entries)  # of fixed size

    def add(total, row):
        sums, counts = total or (np.zeros(book.entries.shape, np.int64), np.zeros(book.entries.shape[:2], np.int64))
        data = columns(row["data"], width)
        for part in range(PARTS):
            mine = data[part * width : (part + 1) * width]
            code, _ = nearest(mine, shared.value[part])
            for d in range(width):
                np.add.at(sums[part, :, d], code, mine[d])
            np.add.at(counts[part], code, 1)
        return sums, counts

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    total = written.select("data").rdd.treeAggregate(None, add, merge, depth)
    shared.unpersist()
    if total is None:
        return book
    sums, counts = total
    used = counts > 0
    entries = book.entries.copy()
    entries[used] = sums[used] // counts[used][:, None]  # floors go down
    return Codebook(entries)


def assigned(book: Codebook, written: DataFrame) -> DataFrame:
    """id, label, code, error of every vector of the blocks."""
    width = book.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*(batch.column(i) for i in range(3))):
                n = len(ids)
                codes, error = np.zeros((PARTS, n), np.uint8), np.zeros(n, np.int64)
                for part in range(PARTS if width else 0):
                    mine = columns(data.as_py(), width)[part * width : (part + 1) * width]
                    codes[part], far = nearest(mine, book.entries[part])
                    error += far
                text = [row.tobytes().hex() for row in np.ascontiguousarray(codes.T)]
                yield pa.RecordBatch.from_pydict({"id": ids.values, "label": labels.values, "code": pa.array(text, pa.string()), "error": pa.array(error)})

    return written.select("ids", "labels", "data").mapInArrow(run, "id long, label string, code string, error long")


def first_codebook(vectors: DataFrame, width: int) -> Codebook:
    """The parts of the ENTRIES smallest ids, each once; of rows that share one the smallest vector's."""
    least = vectors.where("id IS NOT NULL").select("id").distinct().orderBy("id").limit(ENTRIES)
    rows = vectors.join(F.broadcast(least), "id", "left_semi").groupBy("id").agg(F.min("embedding").alias("v")).orderBy("id").collect()
    if not rows:  # no ids at all
        rows = vectors.select(F.col("embedding").alias("v")).orderBy("v").limit(ENTRIES).collect()
    start = scaled([np.array(r["v"], np.float64) for r in rows], width)
    return Codebook(np.ascontiguousarray(start.reshape(PARTS, width, len(rows)).transpose(0, 2, 1)))


def vector_codes(embeddings: DataFrame, rounds: int = 4, depth: int = 2) -> DataFrame:
    """A row a kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold a null or non-finite component are dropped. Components become floor(1024 * x), vectors four parts,
    each of the length of the longest vector's quarter, rounded up. ``rounds`` rounds improve the codebooks, then parts are assigned.

    Defined cases: shorter vectors, and lengths that four doesn't divide, are filled with zeros; components so large that a distance
    would pass 63 bits (beyond 2 ** 17 for 64 of them) count as the largest that can't; repeated rows stay, each with its code, and are
    one entry of the first codebooks; a null vec_id stays null and is the start of no entry unless all are; fewer than 256 ids give fewer
    entries; null labels are one label; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    x = F.col("embedding")
    finite = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    label = F.concat(F.lit("="), F.col("label").cast("string"))
    vectors = embeddings.where(finite).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), "embedding")
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // PARTS)
    written = materialise(blocks(vectors, width), "blocks")
    book = first_codebook(vectors, width)
    for _ in range(rounds if width else 0):
        book = improved(book, written, depth)
    codes = materialise(assigned(book, written).withColumn("label", F.coalesce("label", F.lit(""))), "codes")
    totals = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("rows")), "label-errors")
    return spread_join(codes, totals, "label").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))
