"""The search language: a guard, and a parser into a tree of clauses.

Words and "phrases", (groups), each with +must, -must_not or NOT, joined by AND and OR, field:word, field:IN [a b], word^2 and * for
everything. AND binds closer than OR and than what is only side by side, and what is side by side may match (``a AND b c``: both a and b, or c).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from lattica.schema import QUERY_BYTES, QUERY_DEPTH, VerbError

#: The default fields with their boosts. Each column is indexed twice: by the parts of its identifiers and, _whole, by its whole words.
FIELDS = {"name": 3.0, "name_whole": 3.0, "path": 1.0, "path_whole": 1.0, "content": 1.0, "content_whole": 1.0}
#: Fields that are searched only by name, each value one token.
EXACT = ("node_id", "kind", "raw_name")
#: Other names of fields that a query may use.
ALIASES = {"terms": "name", "terms_whole": "name_whole", "body": "content", "body_whole": "content_whole"}


class Leaf(NamedTuple):
    """A word or a phrase."""

    text: str
    field: str | None = None  # None: the default fields
    boost: float = 1.0

    def sought(self, field: str) -> tuple[str, ...]:
        """Its tokens in a field; more than one are a phrase."""
        return (self.text,) if field in EXACT else tuple(split_whole(self.text) if field.endswith("_whole") else split_code(self.text))


class AnyOf(NamedTuple):
    """A set: any of some tokens of a field, all of one weight."""

    words: tuple[str, ...]
    field: str
    boost: float = 1.0


class Everything(NamedTuple):
    boost: float = 1.0


class Group(NamedTuple):
    clauses: tuple[tuple[str, Node], ...]  # (should, must or must_not; node)
    boost: float = 1.0


Node = Leaf | AnyOf | Everything | Group


def guard(query: str) -> None:
    """Refuses empty, long, deeply nested and range queries."""
    if not query.strip():
        raise VerbError("bad_request", "the query is empty")
    if len(query.encode()) > QUERY_BYTES:
        raise VerbError("bad_request", "the query is too long")
    depth, quoted, before = 0, False, ""
    for i, c in enumerate(query):
        if c == '"' and before != "\\":
            quoted = not quoted
        elif not quoted and before != "\\":
            depth += (c == "(") - (c == ")")
            if depth > QUERY_DEPTH:
                raise VerbError("bad_request", "the query is nested too deeply")
            if c == "{" or c == "[" and not re.search(r"\bIN\s+$", query[:i]) or c in "<>" and re.search(r"(^|[\s(:])$", query[:i]):
                raise VerbError("bad_request", "ranges are not supported")
        before = "" if before == "\\" else c


SPECIAL = r"""\s^`:{}"'\[\]()\\"""
WORD = re.compile(rf"(?![+\-])(?:[^{SPECIAL}]|\\.)(?:[^{SPECIAL}]|\\.)*", re.S)
NAME = re.compile(rf"((?![+\-*])(?:[^{SPECIAL}]|\\.)(?:[^{SPECIAL}]|\\.)*)\s*:", re.S)
QUOTED = re.compile(r""""((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'""", re.S)
SET = re.compile(r"IN\s+\[")
BOOST = re.compile(r"\^(\d+(?:\.\d+)?)")
OPERATORS = ("AND", "OR", "NOT", "IN")


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def wrong(self, what: str) -> VerbError:
        return VerbError("bad_request", f"{what} at character {self.at} of the query")

    def take(self, pattern: re.Pattern | str) -> re.Match | None:
        found = (re.compile(pattern) if isinstance(pattern, str) else pattern).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def boosted(self, node: Node) -> Node:
        return node._replace(boost=node.boost * float(m[1])) if (m := self.take(BOOST)) else node

    def group(self, closed: bool) -> Group:
        """What stands up to the end or, if closed, to a parenthesis."""
        rows: list[tuple[str | None, str | None, Node]] = []  # operator before it, occurrence, node
        while True:
            self.take(r"\s+")
            if self.at == len(self.text) or self.text[self.at] == ")":
                if (self.at == len(self.text)) == closed:
                    raise self.wrong("a parenthesis without its other")
                return Group(tuple(_joined(rows)))
            operator = m[1] if (m := self.take(r"(AND|OR)(?=[\s(])\s*")) else None
            if operator and not rows:
                raise self.wrong("an operator before any word")
            sign = m[0].strip() if (m := self.take(r"[+-]|NOT(?=[\s(])\s*")) else None
            rows.append((operator, {None: None, "+": "must"}.get(sign, "must_not"), self.leaf()))

    def leaf(self) -> Node:
        if self.take(r"\("):
            inner = self.group(closed=True)
            self.at += 1
            return self.boosted(inner)
        if self.take(r"\*(?=[\s)^]|$)"):
            return self.boosted(Everything())
        field = None
        if m := self.take(NAME):
            field = ALIASES.get(m[1], m[1])
            if field not in FIELDS and field not in EXACT:
                raise VerbError("bad_request", f"no field {m[1]}")
            self.take(r"\s*")
        if self.take(SET):
            return self.boosted(self.any_of(field))
        if m := self.take(QUOTED):
            if self.take(r"~\d|\*"):
                raise self.wrong("phrases with gaps or open ends are not supported")
            return self.boosted(Leaf(_plain(m[1] if m[1] is not None else m[2]), field))
        if (m := self.take(WORD)) and m[0] not in OPERATORS:
            return self.boosted(Leaf(_plain(m[0]), field))
        raise self.wrong("no word or group")

    def any_of(self, field: str | None) -> AnyOf:
        if field is None:
            raise self.wrong("a set needs a field")
        words = []
        while not self.take(r"\s*\]"):
            self.take(r"\s+")
            m = self.take(QUOTED) or self.take(WORD)
            if not m:
                raise self.wrong("a set that doesn't end")
            sought = Leaf(_plain(m[0] if m[0][0] not in "\"'" else m[0][1:-1])).sought(field)
            if len(sought) != 1:
                raise self.wrong("a member of a set has to be one word")
            words += sought
        return AnyOf(tuple(dict.fromkeys(words)), field)


def _plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _joined(rows: list[tuple[str | None, str | None, Node]]) -> Iterator[tuple[str, Node]]:
    """Clauses: what AND joins is a group of its own unless it is all there is."""
    runs: list[list[tuple[str, Node]]] = []
    for i, (operator, occur, node) in enumerate(rows):
        ahead = rows[i + 1][0] if i + 1 < len(rows) else None
        told = (occur or ("must" if "AND" in (operator, ahead) else "should"), node)
        if operator == "AND":
            runs[-1].append(told)
        else:
            runs.append([told])
    if len(runs) == 1:
        yield from runs[0]
    else:
        yield from (run[0] if len(run) == 1 else ("should", Group(tuple(run))) for run in runs)


def parse(query: str) -> Group:
    """The tree of a query. What only excludes is refused, as is what can't be read."""
    guard(query)
    tree = _Reader(query).group(closed=False)
    if tree.clauses and all(occur == "must_not" for occur, _ in tree.clauses):
        raise VerbError("bad_request", "the query only excludes")
    return tree


def leaves(node: Node, excluded: bool = False) -> Iterator[tuple[Node, bool]]:
    """The leaves of a tree in order, and whether each is within what is excluded."""
    if isinstance(node, Group):
        for occur, x in node.clauses:
            yield from leaves(x, excluded or occur == "must_not")
    else:
        yield node, excluded


def split_code(text: str) -> list[str]:
    """code_tokens for one string."""
    import regex

    text = regex.sub(r"([\p{Lu}])([\p{Lu}][\p{Ll}])", r"\1 \2", text)
    text = regex.sub(r"([^\p{Lu}])([\p{Lu}])", r"\1 \2", text)
    return split_whole(text)


def split_whole(text: str) -> list[str]:
    """whole_tokens for one string."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]
