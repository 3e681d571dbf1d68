"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries before encoding: between a character that isn't white space and a single space
that another such character follows. No match of the pattern reaches across such a place, so the ids of the parts,
joined, are the ids of the whole text. A part without any safe place is matched by the pattern here, and single
matches of extreme length are merged by a heap in ``O(n log n)``, where the library's own loop would be quadratic.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

from lattica.llm.memo_tokenizer import white

#: Texts over PART characters are cut; matches over LONG bytes are merged by heap.
PART, LONG = 50_000, 4_000
#: A place that no match crosses lies just before such a space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def matcher(pattern: str):
    import regex

    return regex.compile(white(pattern))


def parts(text: str, size: int = PART) -> Iterator[str]:
    """text in parts of at least size characters (but the last), cut at safe places only."""
    start = 0
    while len(text) - start > size and (m := SAFE.search(text, start + size)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one match: lowest rank first, leftmost on ties, by a heap over the neighbours' ranks."""
    n = len(piece)
    if (whole := rank.get(piece)) is not None:
        return [whole]
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here: its end, the start before it
    alive = bytearray(b"\1" * n)

    def pair(i: int) -> tuple[int, int, int] | None:
        j = ends[i]
        if j < n and (r := rank.get(piece[i : ends[j]])) is not None:
            return r, i, ends[j]
        return None

    heap = [x for i in range(n) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue  # one of its parts has merged meanwhile
        j = ends[i]
        alive[j], ends[i] = 0, end
        if end < n:
            before[end] = i
        for k in (before[i], i):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : ends[i]]])
        i = ends[i]
    return out


def encode(text: str, path: str, pattern: str) -> list[int]:
    """The ids of a whole text."""
    enc, out = encoding(path, pattern), []
    for part in parts(text):
        if len(part) <= 2 * PART:
            longest = max(map(len, part.split(" "))) if len(part) > LONG // 4 else 0
            if longest <= LONG // 4 and not re.search(r"\s{1000}", part):
                out += enc.encode_ordinary(part)
                continue
        for m in matcher(pattern).finditer(part):
            piece = m[0].encode()
            out += merge(piece, ranks(path)) if len(piece) > LONG else enc.encode_ordinary(m[0])
    return out


def decode(ids: list[int], path: str, pattern: str) -> bytes:
    """The raw bytes of ids; they needn't be whole characters."""
    return encoding(path, pattern).decode_bytes(ids)


def bpe_round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Defined cases: a null text is empty (no ids, digests of nothing); a null doc_id stays null; an empty table gives no
    rows; lone surrogates can't occur in Spark strings; other columns are ignored.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                ids = encode(text or "", path, pattern)
                rows.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decode(ids, path, pattern)).hexdigest(), ids if with_ids else None))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            out.insert(0, "doc_id", frame["doc_id"].astype("Int64"))
            yield out if with_ids else out.drop(columns="ids")

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, schema)
