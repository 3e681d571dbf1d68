"""Packing by vector bin packing.

An example has a size in three dimensions: tokens, segments (one) and loss-bearing tokens, and a sequence a limit in
each. Sequences are filled one after another from a pool of waiting examples: of those that fit, the one goes in whose
size, in units of the limits, has the largest dot product with what is left of the sequence. So examples that are long
where much is left go first, and none is placed that would leave one dimension full and another empty.

If examples may be cut, whole sequences are cut off long ones, the last gap of each sequence is filled with the head of
the longest waiting example, and what remains at the end is laid out in sequences whose lengths are powers of two,
which need no padding. Each partition packs by itself: no shuffle, and memory for one pool.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lattica.llm.memo_tokenizer import tokenizer

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_to long, ids binary"


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024


class Example(NamedTuple):
    doc_id: int | None
    ids: np.ndarray  # of uint32
    loss: np.ndarray | None  # a flag an id; None: every id bears loss
    start: int = 0  # ids of the document before it
    total: int = 0  # ids of the document

    def size(self) -> tuple[int, int, int]:
        return len(self.ids), 1, len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Example, Example]:
        head = self._replace(ids=self.ids[:at], loss=None if self.loss is None else self.loss[:at])
        return head, self._replace(ids=self.ids[at:], loss=None if self.loss is None else self.loss[at:], start=self.start + at)


def padded(tokens: int, limit: int) -> int:
    """A sequence's length after padding: its own at a power of two, else the limit."""
    return tokens if tokens & (tokens - 1) == 0 else limit


class Packer:
    """Takes examples by add(); gives full sequences, lists of examples, by add() and flush()."""

    def __init__(self, limits: Limits, cut: bool, pool: int = 256) -> None:
        self.limits, self.cut, self.most = np.array(limits, np.int64), cut, pool
        self.waiting: list[Example] = []
        self.sizes = np.zeros((pool + 1, 3), np.int64)

    def add(self, x: Example) -> Iterator[list[Example]]:
        size = x.size()
        if self.cut:
            while size[0] >= self.limits[0]:
                head, rest = x.split(int(self.limits[0]))
                if head.size()[2] > self.limits[2]:
                    head, rest = x.split(self._fitting(x, self.limits))
                yield [head]
                x, size = rest, rest.size()
            if not size[0]:
                return
        elif (np.array(size) > self.limits).any():
            raise ValueError(f"an example of {size} exceeds the limits {tuple(self.limits)} and may not be cut")
        self.sizes[len(self.waiting)] = size
        self.waiting.append(x)
        if len(self.waiting) > self.most:
            yield self._sequence()

    def flush(self) -> Iterator[list[Example]]:
        while self.waiting:
            whole = not self.cut or self.sizes[: len(self.waiting), 0].sum() >= self.limits[0]
            full = self._sequence()
            if whole:
                yield full
            else:
                yield from self._powers(full)

    def _take(self, i: int) -> Example:
        x, last = self.waiting[i], len(self.waiting) - 1
        self.waiting[i], self.sizes[i] = self.waiting[last], self.sizes[last]
        self.waiting.pop()
        return x

    def _fitting(self, x: Example, left: np.ndarray) -> int:
        """How many ids from x's head fit."""
        n = min(len(x.ids), int(left[0]))
        return n if x.loss is None and left[2] >= n else min(n, int(left[2])) if x.loss is None else int(np.searchsorted(np.cumsum(x.loss[:n]), left[2], side="right"))

    def _sequence(self) -> list[Example]:
        left, out = self.limits.copy(), []
        while self.waiting:
            sizes = self.sizes[: len(self.waiting)]
            score = np.where((sizes <= left).all(axis=1), sizes @ (left / self.limits**2), -1.0)
            if score[i := int(score.argmax())] < 0:
                break
            left -= sizes[i]
            out.append(self._take(i))
        if self.cut and self.waiting and left[0] > 0 and left[1] > 0:
            i = int(self.sizes[: len(self.waiting), 0].argmax())
            if at := self._fitting(self.waiting[i], left):
                head, rest = self.waiting[i].split(at)
                out.append(head)
                if len(rest.ids):
                    self.waiting[i], self.sizes[i] = rest, rest.size()
                else:
                    self._take(i)
        return out

    @staticmethod
    def _powers(full: list[Example]) -> Iterator[list[Example]]:
        """The same pieces in sequences of power-of-two lengths, cut where one ends."""
        total, queue = sum(len(x.ids) for x in full), full[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total, out = total - room, []
            while room:
                x = queue.pop()
                if len(x.ids) > room:
                    x, rest = x.split(room)
                    queue.append(rest)
                out.append(x)
                room -= len(x.ids)
            yield out


def pack(examples: Iterable[Example], limits: Limits, cut: bool, partition: int) -> Iterator[tuple]:
    """Rows of PIECES. sequence_id: the partition's number above 40 bits, then a running number."""
    packer, number = Packer(limits, cut), partition << 40

    def sequences() -> Iterator[list[Example]]:
        for x in examples:
            yield from packer.add(x)
        yield from packer.flush()

    for sequence in sequences():
        offset, tokens = 0, sum(len(x.ids) for x in sequence)
        for x in sequence:
            raw = x.ids.astype("<u4").tobytes()
            yield x.doc_id, x.start, len(x.ids), zlib.crc32(raw), x.total, number, offset, tokens, padded(tokens, limits.tokens), raw
            offset += len(x.ids)
        number += 1


def packed(df: DataFrame, examples: Callable[[Iterator[pd.DataFrame]], Iterator[Example]], limits: Limits, cut: bool) -> DataFrame:
    """PIECES of the examples that a function makes of frames."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for row in pack(examples(frames), limits, cut, TaskContext.get().partitionId()):
            rows.append(row)
            size += row[2]
            if size > 2_000_000 or len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return df.mapInPandas(run, PIECES)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 0, limits: Limits = Limits()) -> DataFrame:
    """Whole texts as ids, each with end_id behind, cut freely and packed: a row a piece, as in PIECES; every id is in one piece.

    All ids of a document bear loss. Defined cases: a null or empty text is its end_id alone; a null doc_id stays null;
    rows that repeat a doc_id are packed each; an empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def examples(frames: Iterator[pd.DataFrame]) -> Iterator[Example]:
        of, end = tokenizer(path).encode, int(end_id).to_bytes(4, "little")
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                ids = np.frombuffer(of(text or "") + end, "<u4")
                yield Example(None if doc_id is pd.NA else int(doc_id), ids, None, 0, len(ids))

    return packed(docs.selectExpr("cast(doc_id as long) doc_id", "text"), examples, limits, True)


def pack_conversations(turns: DataFrame, path: str | None = None, end_id: int = 0, limits: Limits = Limits(2048, 16, 1536), answers: str = "assistant") -> DataFrame:
    """Instruction data: a conversation (conv_id, turn, role, text) is an example, its answers bear loss; a row a piece.

    Conversations are kept whole where they fit in one sequence and are cut at the limits otherwise. Turns are ordered by (turn, role,
    text) as they are dealt, and a conversation is held as ids only. Defined cases: null texts are empty; turns without a conv_id are
    conversations of their own, wherever they are; repeated turns are repeated; an empty table gives no rows; other columns are ignored.
    """
    import public_tokenizers
    from pyspark.sql import functions as F

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    told = turns.select(F.col("conv_id").cast("long").alias("doc_id"), "turn", "role", "text")
    alone = F.when(F.col("doc_id").isNull(), F.xxhash64("turn", "role", "text"))
    flat = told.withColumn("alone", alone).repartition("doc_id", "alone").sortWithinPartitions("doc_id", "alone", "turn", "role", "text").select("doc_id", "role", "text")

    def cut(doc_id: int | None, coded: list[np.ndarray], bears: list[bool]) -> Iterator[Example]:
        ids = np.concatenate(coded)
        x = Example(doc_id, ids, np.repeat(bears, [len(c) for c in coded]), 0, len(ids))
        while (np.array(x.size()) > limits).any():
            at = min(limits.tokens, int(np.searchsorted(np.cumsum(x.loss), limits.loss, side="right")))
            head, x = x.split(at)
            yield head
        yield x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[Example]:
        of, end = tokenizer(path).encode, int(end_id).to_bytes(4, "little")
        at, coded, bears = None, [], []
        for frame in frames:
            for doc_id, role, text in zip(frame["doc_id"].astype("Int64"), frame["role"], frame["text"]):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                if coded and (doc_id is None or doc_id != at):
                    yield from cut(at, coded, bears)
                    coded, bears = [], []
                at = doc_id
                coded.append(np.frombuffer(of(text or "") + end, "<u4"))
                bears.append(role == answers)
        if coded:
            yield from cut(at, coded, bears)

    return packed(flat, run, limits, False)
