"""The contracts written down plainly, in loops, for small inputs: what the operators' results are held against."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ids_of(name, text):
    from tokenizers import Tokenizer

    t = ids_of.__dict__.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def op2(docs):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = set()
    for d, t in docs:
        ids = enc.encode_ordinary(t or "")
        out.add((d, len(ids), sha(" ".join(map(str, ids))), sha((t or "").encode())))
    return out


def op3(docs):
    out, at = set(), 0
    for d, t in sorted(docs, key=lambda x: x[0]):
        ids = [*ids_of("word_bpe_49k.json", t), 1]
        out.add((d, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def op4(docs):
    norm = [(d, SPACE.sub(" ", t or "")) for d, t in docs]
    least, n = {}, Counter(t for _, t in norm)
    for d, t in norm:
        least[t] = min(d, least.get(t, d))
    return {(d, least[t], n[t], d == least[t], sha(t)) for d, t in norm}


def op5(docs):
    words = {d: WORD.findall(t or "") for d, t in docs}
    least = {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            least[k] = min(d, least.get(k, d))
    out = set()
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - 49):
            if least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.add((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def op6(pages):
    last = {}
    for p, h in pages:
        last[h or ""] = max(p, last.get(h or "", p))
    out = set()
    for p, h in pages:
        raw, to = (h or "").encode(), last[h or ""]
        out.add((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == to else "revisit", None if p == to else to))
    return out


def fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def op7(docs):
    fps = [(d, fingerprint(t)) for d, t in docs]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for d, f in fps:
        least[find(f)] = min(d, least.get(find(f), d))
    return {(d, f"{f:016x}", least[find(f)]) for d, f in fps}


def op8(docs):
    """The base columns only."""
    out = set()
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        out.add((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    return out
