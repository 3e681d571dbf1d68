"""Token-ID files of patched frame-of-reference blocks.

A file is ``MAGIC``, blocks, a footer and its place. A block holds up to ``BLOCK`` ids: their minimum is subtracted, the
rest is packed at the width that a set share of them fits (``SHARE``), and those that don't fit are kept whole in an
exception list of positions and values. The footer has the place of every block and each document's id, start and length,
so a reader can decode any document's blocks alone.

Documents are range-partitioned by doc_id, so files follow each other in ascending order; a file's first id gets its
place in the whole from the sums of the files before it, a table of a row a file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.llm.common import materialise, opened, scratch, spread
from lattica.llm.memo_tokenizer import tokenizer

MAGIC, BLOCK, SHARE = b"PFORTOK1", 4096, 0.95
HEAD = struct.Struct("<IIBH")  # minimum, ids, width, exceptions
FOOT = struct.Struct("<QQQ")  # blocks, documents, ids
#: A document without doc_id.
NO_ID = -(1 << 63)


def lanes(width: int) -> tuple[str, int]:
    """The smallest number type that holds width bits, and its bits."""
    return (">u2", 16) if width <= 16 else (">u4", 32)


def pack_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    rest = (ids - low).astype(np.uint32)
    widths = np.bincount(np.frexp(rest.astype(np.float64))[1], minlength=33)  # of values by their bits
    width = int(np.searchsorted(np.cumsum(widths), SHARE * len(ids)))
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = rest.copy()
    kept[out] = 0
    kind, room = lanes(width)
    bits = np.unpackbits(kept.astype(kind).view(np.uint8)).reshape(-1, room)[:, room - width :]
    return HEAD.pack(low, len(ids), width, len(out)) + np.packbits(bits.ravel()).tobytes() + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def unpack_block(raw: bytes) -> np.ndarray:
    low, n, width, outs = HEAD.unpack_from(raw)
    at, size = HEAD.size, (n * width + 7) // 8
    kind, room = lanes(width)
    bits = np.zeros((n, room), np.uint8)
    bits[:, room - width :] = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width).reshape(n, width)
    ids = np.packbits(bits.reshape(-1)).view(kind).astype(np.uint32)
    at += size
    ids[np.frombuffer(raw, "<u2", outs, at)] = np.frombuffer(raw, "<u4", outs, at + 2 * outs)
    return ids + np.uint32(low)


class Writer:
    """Takes documents by add(); close() gives the number of ids."""

    def __init__(self, file) -> None:
        self.file, self.at, self.places, self.docs, self.ids = file, len(MAGIC), [], [], 0
        self.waiting, self.waits = [], 0
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.ids, len(ids)))
        self.ids += len(ids)
        self.waiting.append(ids)
        self.waits += len(ids)
        if self.waits >= BLOCK:
            self._blocks(self.waits // BLOCK * BLOCK)

    def _blocks(self, upto: int) -> None:
        flat = np.concatenate(self.waiting)
        for i in range(0, upto, BLOCK):
            raw = pack_block(flat[i : min(i + BLOCK, upto)])
            self.places.append(self.at)
            self.file.write(raw)
            self.at += len(raw)
        self.waiting, self.waits = [flat[upto:]], len(flat) - upto

    def close(self) -> int:
        if self.waits:
            self._blocks(self.waits)
        index = np.array(self.places, "<u8").tobytes() + np.array(self.docs, "<i8").reshape(-1, 3).tobytes()
        self.file.write(index + FOOT.pack(len(self.places), len(self.docs), self.ids) + struct.pack("<Q", self.at) + MAGIC)
        self.file.close()
        return self.ids


class Reader:
    """Reads a file with size() and read_at(n, at)."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        tail = file.read_at(FOOT.size + 8 + len(MAGIC), size - FOOT.size - 8 - len(MAGIC))
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file, or not whole")
        n_blocks, n_docs, self.ids = FOOT.unpack_from(tail)
        (self.end,) = struct.unpack_from("<Q", tail, FOOT.size)
        index = file.read_at(8 * n_blocks + 24 * n_docs, self.end)
        self.places = np.append(np.frombuffer(index, "<u8", n_blocks), np.uint64(self.end)).astype(np.int64)
        self.docs = np.frombuffer(index, "<i8", 3 * n_docs, 8 * n_blocks).reshape(-1, 3)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from start, from the blocks that hold them."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (start + n - 1) // BLOCK
        raw = self.file.read_at(int(self.places[last + 1] - self.places[first]), int(self.places[first]))
        base = self.places[first]
        flat = np.concatenate([unpack_block(raw[self.places[i] - base : self.places[i + 1] - base]) for i in range(first, last + 1)])
        return flat[start - first * BLOCK :][:n]

    def documents(self, ids: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start, ids of every document; neighbours are read together, at least ids at a time."""
        i = 0
        while i < len(self.docs):
            j = int(np.searchsorted(self.docs[:, 1], self.docs[i, 1] + ids, side="left"))
            j = max(j, i + 1)
            start = int(self.docs[i, 1])
            flat = self.span(start, int(self.docs[j - 1, 1:].sum()) - start)
            for doc_id, at, n in self.docs[i:j].tolist():
                yield None if doc_id == NO_ID else doc_id, at, flat[at - start : at - start + n]
            i = j


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 1, folder: str | None = None, most: int = 1 << 24) -> DataFrame:
    """Encodes whole texts, appends end_id to each, writes files of about most ids at the most; returns a row a file: part, seq, file, n_ids, n_docs, before."""
    import public_tokenizers

    path, folder = path or public_tokenizers.path("word_bpe_49k.json"), folder or scratch(docs.sparkSession, "token-files")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, of, end = TaskContext.get().partitionId(), tokenizer(path).encode, int(end_id).to_bytes(4, "little")
        writer, rows = None, []

        def close() -> None:
            rows.append((part, len(rows), name, writer.close(), len(writer.docs)))

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.pfor"  # an attempt that is lost leaves a file that no row names
                    fs, at = opened(name)
                    fs.create_dir(at.rpartition("/")[0])
                    writer = Writer(fs.open_output_stream(at, compression=None))
                writer.add(None if doc_id is pd.NA else int(doc_id), np.frombuffer(of(text or "") + end, "<u4"))
                if writer.ids >= most:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pd.DataFrame(rows, columns=["part", "seq", "file", "n_ids", "n_docs"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = materialise(dealt.mapInPandas(run, "part long, seq long, file string, n_ids long, n_docs long"), "token-file-list")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """A row a document of the files (rows of write_token_files: file, before): doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Defined cases: a document written without a doc_id has null; no files give no rows; a file that is cut short or is none is an error; other
    columns of files are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, before in zip(frame["file"], frame["before"]):
                fs, at = opened(name)
                with fs.open_input_file(at) as f:
                    rows = [(doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for doc_id, start, ids in Reader(f).documents()]
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    return spread(files.select("file", "before")).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Writes and reads back: one row per input row, doc_id, start, n_tokens, ids_crc32.

    Files hold documents in ascending doc_id order, null first, rows of one doc_id in the order of a hash of their texts.
    Defined cases: a null or empty text is its end id alone; an empty table makes no file and gives no rows; other columns are ignored.
    """
    return read_token_files(write_token_files(docs, path, end_id))
