"""Windows over whole texts: by the text's tree, by blank lines, or by lines.

A tree is nested spans of bytes: statements of Python, items and braces of the languages that
`quarry.scanner` reads, sections and paragraphs of markdown, elements of HTML.  Sibling spans are
grouped up to a target, larger ones are descended into, and neighbours are merged again.  A text whose
tree cannot be had, or that is very long, is cut by blank lines.  Languages without trees are grouped by
whole lines.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import scanner
from quarry.operators.chunks import LEAST_CHARS, MOST_BYTES, WINDOW_BYTES

#: A smaller node is not descended into, nor is one that lies deeper; a longer text has no tree.
LEAST_NODE, MOST_DEPTH, MOST_SOURCE = 50, 500, 5_000_000

SCHEMA = "file_id bigint, path string, start_line int, end_line int, text string"
Span = tuple[int, int]


class Node(NamedTuple):
    start: int
    end: int
    children: list[Node] = []


# --- trees ---


def _filled(start: int, end: int, children: list[Node], data: bytes) -> Node:
    """A node whose children leave out nothing but white space: what lies between them is a leaf."""
    out, at = [], start
    for c in [*children, Node(end, end)]:
        if c.start > at and (left := data[at : c.start]).strip():
            first = at + len(left) - len(left.lstrip())
            out.append(Node(first, at + len(left.rstrip())))
        if c.end > c.start:
            out.append(c)
        at = max(at, c.end)
    return Node(start, end, out)


def python_tree(data: bytes) -> Node | None:
    """Statements in statements."""
    try:
        module = ast.parse(data)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = [0, *(m.end() for m in re.finditer(rb"\r\n?|\n", data))]
    place = lambda line, column: lines[line - 1] + column

    def inside(n: ast.AST) -> Iterator[ast.AST]:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, ast.stmt | ast.ExceptHandler):
                yield c
            elif isinstance(c, ast.match_case):
                yield from inside(c)

    def node(n: ast.AST) -> Node:
        first = min([n, *getattr(n, "decorator_list", [])], key=lambda x: x.lineno)
        start = place(first.lineno, first.col_offset) - (first is not n)  # the @ of a decorator
        children = sorted((node(c) for c in inside(n)), key=lambda c: c.start)
        end = place(n.end_lineno, n.end_col_offset)
        return _filled(start, end, children, data) if children else Node(start, end)

    return _filled(0, len(data), [node(n) for n in inside(module)], data)


def _bytes_of(text: str) -> Callable[[int], int]:
    """Byte place of each character."""
    if text.isascii():
        return lambda i: i
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(size)])
    return lambda i: int(at[i])


def bracket_tree(language: str) -> Callable[[bytes], Node | None]:
    """Items, each up to its `;` or closing brace, and the items inside braces."""

    def tree(data: bytes) -> Node | None:
        text = data.decode("utf-8", "replace")
        t, place = scanner.Tokens(text, language), _bytes_of(text)
        begin = lambda i: place(t.start[i])
        after = lambda i: place(t.end_of(i))

        def items(i: int, stop: int, depth: int) -> list[Node]:
            out = []
            while i < stop:
                first, braces = i, []
                while i < stop:
                    if t.value[i] == "{" and depth < MOST_DEPTH:
                        close = min(t.pair[i], stop)
                        inner = items(i + 1, close, depth + 1)
                        to = after(min(close, len(t.value) - 1))
                        braces.append(_filled(begin(i), to, inner, data) if inner else Node(begin(i), to))
                        i = close + 1
                        if i >= stop or t.value[i] not in (";", ",", ")", "=", ".", "while", "else", "catch", "finally"):
                            break
                        continue
                    i += 1
                    if t.value[i - 1] == ";":
                        break
                to = max(after(min(i, stop) - 1), braces[-1].end if braces else 0)
                out.append(_filled(begin(first), to, braces, data) if braces else Node(begin(first), to))
            return out

        return _filled(0, len(data), items(0, len(t.value), 0), data)

    return tree


_HEADING, _FENCE = re.compile(rb"(#{1,6})[ \t]+\S"), re.compile(rb"[ \t]*(```|~~~)")


def markdown_tree(data: bytes) -> Node | None:
    """Sections in sections, and their paragraphs."""
    open_: list[tuple[int, int, list[Node]]] = [(0, 0, [])]
    at, paragraph, fenced = 0, None, False

    def close(level: int, end: int) -> None:
        while open_[-1][0] >= level and len(open_) > 1:
            _, start, children = open_.pop()
            open_[-1][2].append(Node(start, end, children))

    for line in data.splitlines(keepends=True):
        fence = _FENCE.match(line)
        head = None if fenced else _HEADING.match(line)
        blank = not line.strip() and not fenced
        if paragraph is not None and (head or blank):
            open_[-1][2].append(Node(paragraph, at))
            paragraph = None
        if head:
            close(len(head[1]), at)
            open_.append((len(head[1]), at, [Node(at, at + len(line))]))
        elif not blank and paragraph is None:
            paragraph = at
        fenced ^= bool(fence)
        at += len(line)
    if paragraph is not None:
        open_[-1][2].append(Node(paragraph, at))
    close(0, at)
    return Node(0, at, open_[0][2])


_TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][\w:-]*)(?:\"[^\"]*\"|'[^']*'|[^'\">])*?(/?)>", re.S | re.I)
#: Elements that hold nothing.
_VOID = frozenset(b"area base br col embed hr img input link meta source track wbr".split())


def html_tree(data: bytes) -> Node | None:
    """Elements in elements; an end tag without a beginning is passed over, an open element ends with its parent."""
    open_: list[tuple[bytes, int, list[Node]]] = [(b"", 0, [])]
    names: dict[bytes, int] = {}

    def close(end: int) -> None:
        name, start, children = open_.pop()
        names[name] -= 1
        whole = _filled(start, end, children, data) if children else Node(start, end)
        open_[-1][2].append(whole)

    for m in _TAG.finditer(data):
        name = (m[3] or b"").lower()
        if not name or name in _VOID or m[4]:
            open_[-1][2].append(Node(m.start(), m.end()))
        elif not m[2]:
            open_.append((name, m.start(), []))
            names[name] = names.get(name, 0) + 1
        elif names.get(name):
            while open_[-1][0] != name:
                close(m.start())
            close(m.end())
    while len(open_) > 1:
        close(len(data))
    return _filled(0, len(data), open_[0][2], data)


TREES: dict[str, Callable[[bytes], Node | None]] = {
    "python": python_tree, "markdown": markdown_tree, "html": html_tree, **{k: bracket_tree(k) for k in scanner.LANGUAGES},
    "javascript": bracket_tree("typescript"), "tsx": bracket_tree("typescript"),
}


# --- spans ---


def grouped(root: Node, target: int) -> list[Span]:
    """Runs of siblings of at most `target` bytes, not counting what lies between them; a larger node is
    descended into, unless it is a leaf, small or deep."""
    out: list[Span] = []
    todo: list[tuple[Node, int]] = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if not node.children or depth > MOST_DEPTH or node.end - node.start < LEAST_NODE:
            out.append((node.start, node.end))
            continue
        runs: list[Node] = []
        size = target + 1
        for c in node.children:
            own = c.end - c.start
            if own > target:
                runs.append(c)
                size = target + 1
            elif size + own <= target:
                runs[-1] = Node(runs[-1].start, c.end)
                size += own
            else:
                runs.append(Node(c.start, c.end))
                size = own
        todo += [(r, depth + 1) for r in reversed(runs)]
    return out


def merged(spans: list[Span], target: int) -> list[Span]:
    """Neighbours joined while the first's extent and the next one's length come to `target` at most."""
    out: list[Span] = []
    for a, b in spans:
        if out and (out[-1][1] - out[-1][0]) + (b - a) <= target:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _whole(data: bytes, at: int) -> int:
    """The start of the character that holds a byte."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def tree_spans(data: bytes, language: str, target: int) -> list[Span] | None:
    """Spans of MOST_BYTES at most, at whole characters; None for a text without a tree."""
    root = TREES[language](data) if len(data) <= MOST_SOURCE else None
    if root is None:
        return None
    out: list[Span] = []
    for a, b in merged(grouped(root, target), target):
        while b - a > MOST_BYTES:
            cut = _whole(data, a + MOST_BYTES)
            out.append((a, cut))
            a = cut
        out.append((_whole(data, a), _whole(data, b)))
    return [(a, b) for a, b in out if b > a]


def line_spans(data: bytes, target: int) -> list[Span]:
    """Whole lines up to the one that reaches `target` bytes; a span of over MOST_BYTES is cut."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    out, start = [], 0
    while start < len(data):
        k = int(np.searchsorted(ends, start + target))
        end = int(ends[k]) if k < len(ends) else len(data)
        out += [(a, min(a + MOST_BYTES, end)) for a in range(start, end, MOST_BYTES)]
        start = end
    return out


def text_spans(text: str, most: int) -> list[Span]:
    """Spans of characters: whole lines up to `most`, ended sooner where a line follows a blank one and
    half of `most` is reached; a longer line is cut.  Lines end at any of Python's ten line ends."""
    out: list[Span] = []
    start = at = 0
    blank_before = False
    for line in text.splitlines(keepends=True):
        n, held = len(line), at - start
        blank = not line.strip()
        if held and (held + n > most or (blank_before and not blank and held >= most // 2)):
            out.append((start, at))
            start = at
        if n > most:
            out += [(a, min(a + most, at + n)) for a in range(at, at + n, most)]
            start = at + n
        at += n
        blank_before = blank
    if at > start:
        out.append((start, at))
    return out


# --- tables ---


def _rows(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of spans of bytes that hold enough."""
    data = text.encode("utf-8", "replace")
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = lambda at: int(np.searchsorted(ends, at)) + 1
    return [(line(a), line(max(a, _whole(data, b - 1))), body) for a, b, body in spans if len(body.strip()) >= LEAST_CHARS]


def windows_of(text: str, language: str | None, target: int, lines: bool = True) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a text's windows: by its tree, by blank lines where it has none, by
    whole lines (or, without `lines`, by blank lines too) in a language without trees."""
    data = text.encode("utf-8", "replace")
    if lines and language not in TREES:
        return _rows(text, [(a, b, data[a:b].decode("utf-8", "ignore")) for a, b in line_spans(data, target)])
    spans = tree_spans(data, language, target) if language in TREES else None
    if spans is not None:
        return _rows(text, [(a, b, data[a:b].decode("utf-8", "replace")) for a, b in spans])
    place = _bytes_of(text)
    return _rows(text, [(place(a), place(b), text[a:b]) for a, b in text_spans(text, target)])


def windows(files: DataFrame, target: int = WINDOW_BYTES, lines: bool = True) -> DataFrame:
    """(file_id, path, start_line, end_line, text) of files (file_id, path, lang, text), `target` 1 at least.

    A null or blank text has none.  Windows of under 60 characters without white space around them are
    left out.  A file is read once and alone, so long files meet in no task.
    """
    target = max(1, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, path, language, text in zip(*(c.to_pylist() for c in b.columns)):
                if text and text.strip():
                    out += [(i, path, *w) for w in windows_of(text, language, target, lines)]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["file_id", "path", "start_line", "end_line", "text"])

    return files.select("file_id", "path", "lang", F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
