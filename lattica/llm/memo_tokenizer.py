"""Encoding with the tokenizers library, word by word, with a bounded memory of words already encoded.

A text is cut at single spaces between characters that aren't white space. No pre-tokenizer match reaches across such a
space, so the ids of the cuts, joined, are the ids of the text. Each distinct cut is split into the pre-tokenizer's
matches once, each distinct match goes through the library's model once, and repeats are a dictionary look-up. Both
memories hold two generations of at most ``capacity`` entries, so a worker's memory has a bound, and they are given back
when nothing has been encoded for ``IDLE`` seconds: Spark keeps idle workers for later stages, which need the room.

Two kinds of files are understood: byte-level BPE without a normalizer, and lower-cased BPE with word ends. Others are
encoded text by text with the library's own pipeline.
"""

from __future__ import annotations

import re
import threading
import time
import weakref
from array import array
from functools import lru_cache

CUT = re.compile(r"(?<=\S) (?=\S)")
IDLE = 4.0
#: White space besides the space and the line feed.
RARE = tuple(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: Punctuation that, alone after letters, is a match of its own in both kinds of files.
AFTER = frozenset(".,;:!?|%#*&$<>)(\"")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = {}, 0
    for b in range(256):
        out[b] = chr(b if b in shown else 256 + n)
        n += b not in shown
    return out


def white(pattern: str) -> str:
    """The pattern with white space as Unicode's property says, as in the library."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


def cuts(text: str) -> list[str]:
    """text cut at its safe spaces, which are left out. Where no space touches other white space, all of them are safe."""
    if "  " in text or "\n " in text or " \n" in text or any(c in text for c in RARE):
        return CUT.split(text)
    return text.split(" ")


class _Memory(dict):
    """A function's values in two generations: a full one is kept, whole, until the next is full, and what is asked for of it moves on."""

    def __init__(self, of, capacity: int) -> None:
        super().__init__()
        self.of, self.capacity, self.old = of, capacity, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.of(key)
        if len(self) >= self.capacity:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _forget_when_idle(ref: weakref.ref) -> None:
    while (t := ref()) is not None:
        if time.monotonic() - t.used > IDLE:
            t.forget()
        del t
        time.sleep(IDLE / 2)


class MemoTokenizer:
    """encode(text): the ids as little-endian unsigned 32-bit integers, equal to the library's without special tokens."""

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, norm = spec["pre_tokenizer"], spec["normalizer"]
        kinds = [x["type"] for x in before.get("pretokenizers", [])]
        self.kind = ""
        if before["type"] == "ByteLevel" and norm is None and not before["add_prefix_space"] and before["use_regex"]:
            self.kind, pattern = "bytes", public_tokenizers.PATTERN
        elif kinds == ["Split", "ByteLevel"] and [x["type"] for x in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.kind, pattern = "words", before["pretokenizers"][0]["pattern"]["Regex"]
        if self.kind:
            self.matches = regex.compile(white(pattern)).findall
            self.alphabet, self.model, self.norm = byte_alphabet(), self.full.model, self.full.normalizer
            self.by_match = _Memory(self._match, capacity // 2)
            self.by_cut = _Memory(self._cut, capacity)
            self.used = time.monotonic()
            threading.Thread(target=_forget_when_idle, args=(weakref.ref(self),), daemon=True).start()

    def forget(self) -> None:
        for memory in (self.by_match, self.by_cut):
            memory.old = {}
            memory.clear()

    def _match(self, m: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(m.encode().decode("latin-1").translate(self.alphabet))]).tobytes()

    def _cut(self, cut: str) -> bytes:
        if self.kind == "words":
            cut, lead = cut.lower() if cut.isascii() else self.norm.normalize_str(cut), ""
        else:
            lead = " "
        if cut.isalpha():
            return self.by_match[lead + cut]
        if cut[-1:] in AFTER and cut[:-1].isalpha():
            return self.by_match[lead + cut[:-1]] + self.by_match[cut[-1]]
        return b"".join([self.by_match[m] for m in self.matches(lead + cut)])

    def encode(self, text: str) -> bytes:
        self.used = time.monotonic()
        if self.kind == "words":
            # white space is never part of a match, so that any space is a safe cut
            return b"".join(map(self.by_cut.__getitem__, text.replace("\n", " ").split(" ")))
        if self.kind == "bytes":
            first, *rest = cuts(text)
            head = b"".join([self.by_match[m] for m in self.matches(first)])
            return head + b"".join(map(self.by_cut.__getitem__, rest)) if rest else head
        return array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> MemoTokenizer:
    """One a process, kept between tasks."""
    return MemoTokenizer(path)
