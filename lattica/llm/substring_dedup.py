"""Substring dedup with a count-min prefilter.

A window is ``WIDTH`` consecutive words. Every window is judged by its anchor, the smallest hash among the ``GRAM``-word
sequences in it: equal windows have equal anchors, and a run of windows shares one, so there are about sixteen times fewer
anchors than windows. 1. Each partition counts, in a count-min sketch, the documents that hold an anchor; partition
sketches travel as lists of touched counters and are merged block by block, saturating at two. A window's estimate is the
smallest of its anchor's counters: never below the number of documents that hold the window. 2. A second pass over the
texts hashes (128 bits) only the windows estimated repeated and groups them exactly, so none is lost and none removed by
an overestimate. The smallest document of a window is found with partial minima before the shuffle.

Documents with equal word sequences are represented by the one with the smallest id: in the others every window also
starts in a smaller document. The second kind of broadcast, a bit map of the representatives' hashes, lets the passes
skip most of the others; one that isn't skipped changes nothing.

Sketch and bit map follow the corpus's size, up to ``2 ** max_log2`` counters a row: their broadcasts are bounded (a bit
a counter), and beyond it estimates only get more generous, results stay exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import as_rows, materialise, text_key

WIDTH, GRAM, DEPTH, LOG2_BLOCK = 50, 20, 2, 16
#: Odd multipliers of the polynomial hashes and of the sketch's rows.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
ROWS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p ** i and its inverses modulo 2 ** 64 for i < n."""
    if p not in _powers or len(_powers[p][0]) < n:
        size = max(n, 1 << 15)
        make = lambda x: np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))))
        _powers[p] = make(p), make(pow(p, -1, 1 << 64))
    return _powers[p]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that breaks the structure of sums."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, width: int, p: int) -> np.ndarray:
    """A hash of every width consecutive entries of h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(p, len(h) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mixed((sums[width:] - sums[:-width]) * down[:n])


def anchors(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """For every window its smallest hash of gram words."""
    g = window_hashes(h, gram, MULTIPLIERS[0])
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        g = np.minimum(g[:-have], g[have:])
        have *= 2
    return np.minimum(g[: len(g) - (span - have)], g[span - have :]) if span > have else g


def counters(a: np.ndarray, log2: int) -> list[np.ndarray]:
    """The counters of anchors in each row of the sketch."""
    return [((a * np.uint64(m)) >> np.uint64(64 - log2)).astype(np.int64) for m in ROWS]


def in_bits(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def row_keys(doc_ids: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """A hash of each document's id and word sequence."""
    return mixed(np.asarray(doc_ids, np.int64).view(np.uint64) ^ mixed(halves(digests)))


def word_sequences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, seq (a digest of the word sequence), its first half and row_key of the rows of WIDTH words and more."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            enough, seqs = np.zeros(len(frame), bool), []
            for i, text in enumerate(frame["text"]):  # one document's words at a time
                words = text.encode().split()
                if len(words) >= WIDTH:
                    enough[i] = True
                    seqs.append(digest(words))
            of = frame[enough]
            yield pd.DataFrame({"doc_id": of["doc_id"], "text_key": of["text_key"], "seq": seqs, "half": halves(seqs).view(np.int64), "row_key": row_keys(of["doc_id"].to_numpy(), seqs).view(np.int64)})

    return docs.select("doc_id", "text_key", "text").mapInPandas(run, "doc_id long, text_key long, seq binary, half long, row_key long")


def blocks(seen: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Touched counters by block: those touched, and of them those touched twice or more."""
    if not seen:
        return
    at, n = np.unique(np.concatenate(seen), return_counts=True)
    block, edges = np.unique(at >> LOG2_BLOCK, return_index=True)
    low = (at & ((1 << LOG2_BLOCK) - 1)).astype("<u2")
    edges = [*edges.tolist(), len(at)]
    rows = [(int(b), low[i:j].tobytes(), low[i:j][n[i:j] > 1].tobytes()) for b, i, j in zip(block, edges, edges[1:])]
    for i in range(0, len(rows), 512):
        yield pd.DataFrame(rows[i : i + 512], columns=["block", "once", "twice"])


def merged_bits(touched: DataFrame, size: int, at_least: int) -> np.ndarray:
    """Merges blocks of counters, saturating at two; a bit each of size counters, set where the count is at_least or more."""

    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros(1 << LOG2_BLOCK, np.uint8)
        for frame in frames:
            for once, twice in zip(frame["once"], frame["twice"]):
                count[np.frombuffer(once, "<u2")] += 1
                count[np.frombuffer(twice, "<u2")] = 2
                np.minimum(count, 2, out=count)
        yield pd.DataFrame({"block": [key[0]], "bits": [np.packbits(count >= at_least).tobytes()]})

    bits = np.zeros(size >> 3, np.uint8)
    for row in touched.groupBy("block").applyInPandas(merge, "block long, bits binary").toLocalIterator():  # size bits in all
        at = row["block"] << (LOG2_BLOCK - 3)
        bits[at : at + (1 << (LOG2_BLOCK - 3))] = np.frombuffer(row["bits"], np.uint8)
    return bits


BLOCKS = "block long, once binary, twice binary"


def known_rows(first: DataFrame, log2: int) -> np.ndarray:
    """A bit map of the hashes of rows (column row_key)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from blocks([(frame["row_key"].to_numpy().view(np.uint64) >> np.uint64(64 - log2)).astype(np.int64)])

    return merged_bits(first.select("row_key").mapInPandas(run, BLOCKS), 1 << log2, 1)


def representatives(frame: pd.DataFrame, known: np.ndarray, log2: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """doc_id, seq and words of a frame's rows of WIDTH words and more, without (most of) those that another row represents."""
    for doc_id, text in zip(frame["doc_id"], frame["text"]):
        words = text.encode().split()
        if len(words) >= WIDTH:
            seq = digest(words)
            if in_bits(known, (row_keys(np.array([doc_id]), [seq]) >> np.uint64(64 - log2)).astype(np.int64))[0]:
                yield doc_id, seq, words


def sketch_of(docs: DataFrame, known, known_log2: int, log2: int) -> np.ndarray:
    """The merged count-min sketch, a bit a counter, set where two documents or more were counted; its rows lie behind each other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, size = [], 0
        for frame in frames:
            for _, _, words in representatives(frame, known.value, known_log2):
                for r, c in enumerate(counters(np.unique(anchors(word_hashes(words))), log2)):
                    seen.append(np.unique(c) + (r << log2))  # a document counts once in a counter
                    size += len(c)
            if size > 4_000_000:
                yield from blocks(seen)
                seen, size = [], 0
        yield from blocks(seen)

    return merged_bits(docs.select("doc_id", "text").mapInPandas(run, BLOCKS), DEPTH << log2, 2)


def candidates(docs: DataFrame, known, known_log2: int, sketch, log2: int) -> DataFrame:
    """h1, h2, doc_id, half, at: the windows estimated to start in two documents or more. A document's id and half a digest of its words name it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, size = [], 0
            for doc_id, seq, words in representatives(frame, known.value, known_log2):
                h = word_hashes(words)
                a = anchors(h)
                keep = np.ones(len(a), bool)
                for r, c in enumerate(counters(a, log2)):
                    keep &= in_bits(sketch.value, c + (r << log2))
                if len(at := np.flatnonzero(keep)):
                    h1, h2 = (window_hashes(h, WIDTH, p)[at].view(np.int64) for p in MULTIPLIERS)
                    out.append(pd.DataFrame({"h1": h1, "h2": h2, "doc_id": doc_id, "half": halves([seq]).view(np.int64)[0], "at": at.astype(np.int32)}))
                    size += len(at)
                if size > 100_000:
                    yield pd.concat(out)
                    out, size = [], 0
            if out:
                yield pd.concat(out)

    return docs.select("doc_id", "text").mapInPandas(run, "h1 long, h2 long, doc_id long, half long, at int")


def log2_for(n: int, max_log2: int) -> int:
    return min(max_log2, max(LOG2_BLOCK, int(n).bit_length()))


def removals(docs: DataFrame, max_log2: int = 30) -> DataFrame:
    """doc_id, text_key, whole, spots of the rows that lose words: all of them (whole), or those of the windows at spots."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key")).where("doc_id is not null and text is not null")
    marks = materialise(word_sequences(base), "word-sequences")
    first = materialise(marks.groupBy("seq").agg(F.min(F.struct("doc_id", "row_key")).alias("of")).select("seq", F.col("of.doc_id").alias("first_id"), "of.row_key"), "first-of-equal")
    n_docs, n_chars = first.count(), base.agg(F.sum(F.length("text"))).first()[0] or 0
    known_log2 = log2_for(8 * n_docs, max_log2)
    log2 = log2_for(n_chars // 24, max_log2)  # about six characters a word and sixteen windows an anchor: four counters an anchor
    known = spark.sparkContext.broadcast(known_rows(first, known_log2))
    sketch = spark.sparkContext.broadcast(sketch_of(base, known, known_log2, log2))
    found = materialise(candidates(base, known, known_log2, sketch, log2), "candidate-windows")
    least = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").select("h1", "h2", "least")
    least = materialise(least, "repeated-windows")  # written, so that both sides of the join are plain shuffles, whose hot keys can be split
    again = found.join(least, ["h1", "h2"]).where("doc_id > least")
    spots = again.groupBy("doc_id", "half").agg(F.sort_array(F.collect_set("at")).alias("spots"))
    told = marks.join(first.select("seq", "first_id"), "seq").join(spots, ["doc_id", "half"], "left")
    whole = F.col("doc_id") > F.col("first_id")
    return told.where(whole | F.col("spots").isNotNull()).select("doc_id", "text_key", whole.alias("whole"), "spots").dropDuplicates(["doc_id", "text_key"])


def without(text: str, whole: bool, spots) -> str:
    """text without the words of the windows at spots, or without all; what is left keeps its white space."""
    raw = text.encode()
    if whole:
        return ""
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    gone = np.zeros(len(places) + 1, np.int64)
    np.add.at(gone, np.asarray(spots), 1)
    np.add.at(gone, np.minimum(np.asarray(spots) + WIDTH, len(places)), -1)
    gone = np.cumsum(gone[:-1]) > 0
    out, at = [], 0
    for (a, b), x in zip(places, gone.tolist()):
        if x:
            out.append(raw[at:a])
            at = b
    return b"".join([*out, raw[at:]]).decode()


def _without(texts: pd.Series, wholes: pd.Series, spots: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else without(t, bool(w), s) for t, w, s in zip(texts, wholes, spots)], dtype=object)


def substring_dedup(docs: DataFrame, max_log2: int = 30) -> DataFrame:
    """docs with all its columns, the text without repeated passages.

    Removed is each word covered by a window of 50 words that also starts in a document with a smaller doc_id; windows are
    judged on the input. White space around removed words stays. Defined cases: a null text stays null; a row with a null
    doc_id is compared with none; rows that repeat a doc_id are not compared with each other; texts under 50 words stay as
    they are; texts that lose nothing are returned unchanged; an empty table gives no rows.
    """
    info, rows = removals(docs, max_log2), as_rows(docs)
    text = F.col("row.text")
    joined = rows.join(info, (F.col("row.doc_id") == info["doc_id"]) & (text_key(text) == info["text_key"]), "left")
    hit = F.col("whole").isNotNull()
    cut = F.pandas_udf(_without, "string")(F.when(hit, text), F.when(hit, F.col("whole")), F.when(hit, F.col("spots")))
    return joined.withColumn("cut", cut).select(F.col("row").withField("text", F.when(hit, F.col("cut")).otherwise(text)).alias("row")).select("row.*")
