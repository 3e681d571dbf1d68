"""Tokenizers of code and of whole words, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between "HTTP" and "Server", and between a character that is no upper-case letter and one that is.
CAMEL = ((r"([\p{Lu}])([\p{Lu}][\p{Ll}])", "$1 $2"), (r"([^\p{Lu}])([\p{Lu}])", "$1 $2"))
BREAK = r"[^\p{L}\p{N}]+"


def code_tokens(text: Column) -> Column:
    """Lower-cased parts of identifiers, in order: split at what is neither letter nor number and at camel boundaries."""
    return whole_tokens(parted(text))


def parted(text: Column) -> Column:
    """Camel boundaries as spaces."""
    for pattern, to in CAMEL:
        text = F.regexp_replace(text, pattern, to)
    return text


def whole_tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def spaced(text: Column) -> Column:
    """The whole tokens, which hold no space, joined by one."""
    return F.trim(F.regexp_replace(F.lower(text), BREAK, " "))
