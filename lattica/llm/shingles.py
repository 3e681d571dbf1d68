"""Shingles of a text as hashes, and the SimHash fingerprint of these."""

from __future__ import annotations

import numpy as np
import xxhash

BITS = 64


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """The XXH64 of a text's shingles, repeats included; fewer words are one shingle. A-Z are lower-cased, words parted by ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    of = xxhash.xxh64_intdigest
    return np.fromiter((of(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64, len(words) - k + 1)


def fingerprint(h: np.ndarray) -> int:
    """64 bits: each set if it is set in over half of the hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        counts += np.unpackbits(h[i : i + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")
