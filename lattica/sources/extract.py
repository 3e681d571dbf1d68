"""Language packs: a file's declarations, references and imports as rows.

Python goes through the standard library's parser. The brace languages go through one scanner that blanks comments and
strings, keeps every position, and finds declarations, their bodies and the calls in them.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, language string, fact string, name string, bare string, owner string, qualifier string, line int, col int"


class Fact(NamedTuple):
    """fact: symbol (name as stored, bare name), call (owner: the calling symbol's name; qualifier: what stands before the dot), import, method (of the type qualifier), interface_method or embed (of the interface owner)."""

    fact: str
    name: str
    bare: str | None = None
    owner: str | None = None
    qualifier: str | None = None
    at: int = 0  # character


def blank(text: str, line: str = "//", quotes: str = "\"'`", blocks: bool = True) -> str:
    """text with comments and the inside of strings as spaces, at the same length."""
    parts = [rf"{line}[^\n]*"] + [r"/\*.*?(?:\*/|\Z)"] * blocks
    parts += [rf"{q}(?:\\.|[^{q}\\{'' if q == '`' else chr(10)}])*{q}" for q in quotes]
    return re.sub("|".join(parts), lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(code: str, at: int, pair: str = "{}") -> int:
    """The place behind what closes the bracket at at."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.end()
    return len(code)


def depth_at(code: str) -> Callable[[int], int]:
    places, depths, d = [-1], [0], 0
    for m in re.finditer("[{}]", code):
        d += 1 if m[0] == "{" else -1
        places.append(m.start())
        depths.append(d)
    return lambda at: depths[bisect.bisect_left(places, at) - 1]


KEYWORDS = frozenset("if for switch return func go defer select case range map chan struct interface catch while else try new super this function typeof await async yield match loop unsafe fn let const static in of do throw synchronized assert instanceof import export default class extends implements sizeof make".split())
CALL = re.compile(r"(?:\b([A-Za-z_$][\w$]*)\s*(?:\.|::)\s*)?\b([A-Za-z_$][\w$]*)\s*(?:::<[^<>]*>|<[\w, ]*>)?\(")


def calls(code: str, start: int, end: int, owner: str, skip: list[tuple[int, int]] = ()) -> Iterator[Fact]:
    for m in CALL.finditer(code, start, end):
        if m[2] not in KEYWORDS and not any(a <= m.start(2) < b for a, b in skip) and not re.search(r"\b(func|fn|function|class)\s*$", code[max(start, m.start() - 12) : m.start()]):
            yield Fact("call", m[2], m[2], owner, m[1] if m[1] not in ("this", "self", "cls", "super") else None, m.start(2))


def go(text: str) -> Iterator[Fact]:
    code = blank(text)
    top = depth_at(code)
    for m in re.finditer(r'(?m)^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?"[^"\n]+"))', text):
        body = m[1] if m[1] is not None else m[2]
        for x in re.finditer(r'(?:([\w.]+)\s+)?"([^"\n]+)"', body):
            yield Fact("import", x[2], x[2].rpartition("/")[2], None, x[1], m.start() + x.start())
    for m in re.finditer(r"(?m)^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\(", code):
        name = f"{m[1]}.{m[2]}" if m[1] else m[2]
        yield Fact("symbol", name, m[2], None, m[1], m.start(2))
        if m[1]:
            yield Fact("method", m[2], m[2], None, m[1], m.start(2))
        after = closing(code, m.end() - 1, "()")
        brace = re.compile(r"[^\n{]*(?:\n\s*)?\{").match(code, after)
        if brace:
            yield from calls(code, brace.end(), closing(code, brace.end() - 1), name)
    for m in re.finditer(r"(?m)^(type|const)\b\s*(\()?", code):
        spans = [(m.end(), closing(code, m.end() - 1, "()") - 1)] if m[2] else [(m.end(), code.find("\n", m.end()) if code.find("\n", m.end()) >= 0 else len(code))]
        for a, b in spans:
            base = top(a) if m[2] else 0
            for x in re.finditer(r"(?m)^\s*(\w+)" if m[2] else r"\s*(\w+)", code[a:b]):
                if not m[2] and x.start():
                    break
                at = a + x.start(1)
                if top(at) != base or not x[1].isidentifier():
                    continue
                yield Fact("symbol", x[1], x[1], None, None, at)
                shape = re.compile(r"\s*(?:\[[^\]]*\])?\s*(interface|struct)\s*\{").match(code, a + x.end(1))
                if m[1] == "type" and shape:
                    inner = code[shape.end() : closing(code, shape.end() - 1) - 1]
                    for y in re.finditer(r"(?m)^\s*(?:\*?\s*((?:\w+\.)?\w+)\s*$|(\w+)\s*\()", inner):
                        if y[2] and shape[1] == "interface":
                            yield Fact("interface_method", y[2], y[2], x[1], None, shape.end() + y.start(2))
                        elif y[1]:
                            yield Fact("embed", y[1], y[1].rpartition(".")[2], x[1], shape[1], shape.end() + y.start(1))


def braces(text: str, types: str, functions: str, imports: str, line: str = "//", quotes: str = "\"'`", extra: str | None = None, type_calls: bool = True) -> Iterator[Fact]:
    """Declarations by patterns (group 1 a name), at the top or in a type's body; the innermost declaration owns a call."""
    code = blank(text, line, quotes)
    top = depth_at(code)
    for m in re.finditer(imports, text):
        path = next(x for x in m.groups() if x)
        yield Fact("import", path, path, None, None, m.start())
    spans: list[tuple[int, int, str]] = []
    kinds: list[tuple[int, int, str]] = []
    declared: set[int] = set()
    for m in re.finditer(types, code):
        brace = re.compile(r"[^;{]*\{").match(code, m.end())
        end = closing(code, brace.end() - 1) if brace else m.end()
        if not m[0].lstrip().startswith("impl"):
            yield Fact("symbol", m[1], m[1], None, None, m.start(1))
            if type_calls:
                spans.append((m.end(), end, m[1]))
        kinds.append((m.end(), end, m[1]))
    for m in re.finditer(functions, code):
        name = m[m.lastindex]
        if name in KEYWORDS:
            continue
        declared.add(m.start(m.lastindex))
        holder = [k for k in kinds if k[0] <= m.start() < k[1]]
        kind = min(holder, key=lambda k: k[1] - k[0])[2] if holder else None
        full = f"{kind}.{name}" if kind else name
        after = closing(code, m.end() - 1, "()") if code[m.end() - 1] == "(" else m.end()
        brace = re.compile(r"[^;{}=]*(?:=>\s*)?\{").match(code, after)
        yield Fact("symbol", full, name, None, kind, m.start())
        if brace:
            spans.append((brace.end(), closing(code, brace.end() - 1), full))
    for m in re.finditer(extra, code) if extra else ():
        if top(m.start(1)) == 0:
            yield Fact("symbol", m[1], m[1], None, None, m.start(1))
    for a, b, name in spans:
        inner = [(x, y) for x, y, _ in spans if a < x and y <= b]
        yield from (f for f in calls(code, a, b, name, inner) if f.at not in declared)


def ecmascript(text: str) -> Iterator[Fact]:
    found = braces(
        text, r"\b(?:class|interface|enum)\s+(\w+)", r"\bfunction\s*\*?\s*(\w+)\s*(?:<[^>]*>)?\(|(?m:^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(\w+)\s*(?:<[^>]*>)?\()(?=[^)]*\)[^;{}\n]*\{)",
        r"""(?m)^\s*(?:import|export)\b[^;'"\n]*?['"]([^'"\n]+)['"]|\brequire\(\s*['"]([^'"\n]+)['"]""", extra=r"(?m)^(?:export\s+)?(?:const|let|var|type)\s+(\w+)",
    )
    return (f for f in found if not (f.fact == "import" and re.match(r"\.{1,2}(/|$)", f.name)))


def rust(text: str) -> Iterator[Fact]:
    found = braces(
        text, r"\b(?:struct|enum|trait|union|impl(?:<[^>]*>)?(?:\s+[\w:<>, ]+\s+for)?)\s+(\w+)", r"\bfn\s+(\w+)\s*(?:<[^(]*>)?\(",
        r"(?m)^\s*(?:pub\s+)?use\s+(\w+)", quotes='"', extra=r"(?m)^(?:pub(?:\([^)]*\))?\s+)?(?:const|static|type)\s+(?:mut\s+)?(\w+)",
    )
    return (f for f in found if not (f.fact == "import" and f.name in ("crate", "self", "super", "Self")))


def java(text: str) -> Iterator[Fact]:
    return braces(
        text, r"\b(?:class|interface|enum|record)\s+(\w+)", r"(?m)^[ \t]++(?!return\b|new\b|throw\b|else\b|case\b|assert\b)(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]*>\s*)?(?:[\w.<>\[\], ?]+\s+)?(\w+)\s*\((?=[^)]*\)[^;{}]*[{;])",
        r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", quotes="\"'", type_calls=False,
    )


def python(text: str) -> Iterator[Fact]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    starts = [0]
    for row in text.split("\n"):
        starts.append(starts[-1] + len(row) + 1)
    rows = text.split("\n")
    at = lambda n: starts[n.lineno - 1] + len(rows[n.lineno - 1].encode()[: n.col_offset].decode(errors="ignore"))

    def walk(node: ast.AST, prefix: str, owner: str | None) -> Iterator[Fact]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                name = f"{prefix}.{child.name}" if prefix else child.name
                yield Fact("symbol", name, child.name, None, prefix or None, at(child))
                yield from walk(child, "", name)
            elif isinstance(child, ast.ClassDef):
                yield Fact("symbol", child.name, child.name, None, None, at(child))
                yield from walk(child, child.name, None)
            else:
                if isinstance(child, (ast.Assign, ast.AnnAssign)) and node is tree:
                    for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                        if isinstance(t, ast.Name):
                            yield Fact("symbol", t.id, t.id, None, None, at(t))
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        yield Fact("import", a.name, a.name, None, a.asname, at(child))
                elif isinstance(child, ast.ImportFrom) and not child.level and child.module:
                    yield Fact("import", child.module, child.module, None, None, at(child))
                elif isinstance(child, ast.Call) and owner:
                    f = child.func
                    if isinstance(f, ast.Name):
                        yield Fact("call", f.id, f.id, owner, None, at(f))
                    elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name) and f.value.id in ("self", "cls"):
                        yield Fact("call", f.attr, f.attr, owner, None, at(f))
                yield from walk(child, prefix if isinstance(node, ast.ClassDef) else "", owner)

    yield from walk(tree, "", None)


PACKS: dict[str, Callable[[str], Iterator[Fact]]] = {"go": go, "typescript": ecmascript, "tsx": ecmascript, "javascript": ecmascript, "python": python, "rust": rust, "java": java}


def facts(text: str, language: str) -> Iterator[tuple[Fact, int, int]]:
    """Facts with their line and column from 1; the column counts bytes."""
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    seen = set()
    for f in sorted(PACKS[language](text), key=lambda f: f.at):
        line = bisect.bisect_right(starts, f.at)
        if (f, line) not in seen:
            seen.add((f, line))
            yield f, line, len(text[starts[line - 1] : f.at].encode()) + 1


def extract(files: DataFrame) -> DataFrame:
    """files (path, language, content) to facts; files without content or pack have none. A file is worked on alone, so memory is that of one file.

    A file takes far longer to work on than to send, and a small table of many files may be read by one task, so files are dealt to all tasks first.
    """
    context = files.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, lang, f.fact, f.name, f.bare, f.owner, f.qualifier, line, col) for path, lang, text in zip(frame["path"], frame["language"], frame["content"]) if text and lang in PACKS for f, line, col in facts(text, lang)]
            yield pd.DataFrame(rows, columns=["path", "language", "fact", "name", "bare", "owner", "qualifier", "line", "col"])

    return files.select("path", "language", "content").repartition(tasks, "path").mapInPandas(run, SCHEMA)
