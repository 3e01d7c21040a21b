"""Symbols from source text: Python by its own grammar, markdown by headings, five languages by a scanner.

No grammars are at hand.  Go, Rust, TypeScript, Java and C are read by `quarry.scanner`; the others are
approximate: a declaration keyword before a name is a definition that ends where its braces close or
its indentation does, and `name(` is a call.
"""

from __future__ import annotations

import ast
import bisect
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import scanner
from quarry.operators.rerank import KEYWORDS
from quarry.operators.symbols import Around

#: Raised with every change of what a text's symbols are: an index of another revision is built anew.
REVISION = 3
SCHEMA = "file_id bigint, name string, tag string, start_line int, end_line int, signature string, enclosing_name string, kind string, ordinal int"
_DECLARED = re.compile(rf"^[ \t]*(?:(?:pub(?:lic)?|private|protected|static|export|default|async|final|abstract|open|override|inline|const|unsafe|local)\s+)*(?:{'|'.join(k for k in KEYWORDS if ' ' not in k)})\s+([A-Za-z_]\w*)", re.M)
_CALLED = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$")


def _signature(text: str) -> str | None:
    return text.strip()[:500] or None


def python_symbols(text: str) -> list[tuple]:
    """Classes, functions and module constants; calls, members, capitalised receivers and annotations."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    lines, defs, refs = text.split("\n"), [], {}
    top = {id(n) for n in tree.body}

    def annotation(node: ast.AST) -> None:
        for n in ast.walk(node):
            if isinstance(n, ast.Name):
                refs[n.lineno, n.col_offset] = n.id
            elif isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
                refs[n.lineno, n.col_offset] = n.value

    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            head = "\n".join(lines[n.lineno - 1 : max(n.lineno, n.body[0].lineno - (n.body[0].lineno > n.lineno))])
            defs.append((n.lineno, n.end_lineno, n.name, _signature(head.rstrip().removesuffix(":")), "class" if isinstance(n, ast.ClassDef) else "function"))
            if not isinstance(n, ast.ClassDef):
                for a in [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs, n.args.vararg, n.args.kwarg]:
                    if a is not None and a.annotation is not None:
                        annotation(a.annotation)
                if n.returns is not None:
                    annotation(n.returns)
        elif isinstance(n, ast.Assign) and id(n) in top and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            defs.append((n.lineno, n.end_lineno, n.targets[0].id, _signature(lines[n.lineno - 1]), "constant"))
        elif isinstance(n, ast.AnnAssign):
            annotation(n.annotation)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            refs[n.func.lineno, n.func.col_offset] = n.func.id
        if isinstance(n, ast.Attribute):
            refs[n.end_lineno, n.end_col_offset - len(n.attr.encode())] = n.attr
            if isinstance(n.value, ast.Name) and n.value.id[:1].isupper():
                refs[n.value.lineno, n.value.col_offset] = n.value.id
    return _rows(sorted(defs), [(line, name) for (line, _), name in sorted(refs.items())])


def markdown_symbols(text: str) -> list[tuple]:
    """ATX headings: a section ends where its first subsection, or the next section, begins."""
    heads, fenced = [], False
    lines = text.split("\n")
    for i, line in enumerate(lines, 1):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and (m := _HEADING.match(line)):
            heads.append((i, m[2], line))
    ends = [h[0] - 1 for h in heads[1:]] + [len(lines)]
    return _rows([(i, max(i, e), name, _signature(line), "section") for (i, name, line), e in zip(heads, ends)], [])


def keyword_symbols(text: str) -> list[tuple]:
    lines, defs = text.split("\n"), []
    ends = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(ends, at) + 1
    for m in _DECLARED.finditer(text):
        at = line_of(m.start(1))
        indent = len(lines[at - 1]) - len(lines[at - 1].lstrip())
        depth, end = 0, at
        for k in range(at - 1, len(lines)):
            line = lines[k]
            if k > at - 1 and depth == 0 and line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            depth += line.count("{") - line.count("}")
            if line.strip():
                end = k + 1
            if depth <= 0 and "}" in line:
                break
        defs.append((at, end, m[1], _signature(lines[at - 1].split("{")[0]), m[0].split()[-2]))
    names = {(d[0], d[2]) for d in defs}
    found = ((line_of(m.start(1)), m[1]) for m in _CALLED.finditer(text))
    return _rows(defs, [(at, name) for at, name in found if (at, name) not in names and name not in ("if", "for", "while", "switch", "return", "catch")])


def scanned_symbols(language: str):
    def read(text: str) -> list[tuple]:
        defs, uses = scanner.scan(text, language)
        return _rows([(d.start_line, d.end_line, d.name, d.signature, d.kind) for d in defs], [(u.start_line, u.name) for u in uses])

    return read


def _rows(defs: list[tuple], refs: list[tuple]) -> list[tuple]:
    """(name, tag, start, end, signature, enclosing name, kind): a reference belongs to the shortest span around it."""
    out = [(name, "def", a, b, sig, None, kind) for a, b, name, sig, kind in defs]
    waiting, around = sorted(range(len(defs)), key=lambda k: -defs[k][0]), Around()
    for at, name in sorted(refs, key=lambda r: r[0]):
        while waiting and defs[waiting[-1]][0] <= at:
            k = waiting.pop()
            around.open(defs[k][0], defs[k][1], k)
        k = around.at(at)
        out.append((name, "ref", at, at, None, None if k is None else defs[k][2], None))
    return out


#: How each language is read; CODE without a reader of its own by keywords.
READERS = {"python": python_symbols, "markdown": markdown_symbols, **{k: scanned_symbols(k) for k in scanner.LANGUAGES}, "javascript": scanned_symbols("typescript"), "tsx": scanned_symbols("typescript")}


def extracted(files: DataFrame) -> DataFrame:
    """Symbol rows of files with file_id, lang, text; languages without a reader have none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, lang, text in zip(pdf["file_id"], pdf["lang"], pdf["text"]):
                read = READERS.get(lang, keyword_symbols if lang in CODE else None)
                rows += [(i, *r, k) for k, r in enumerate(read(text or "") if read else [])]
            out = pd.DataFrame(rows, columns=["file_id", "name", "tag", "start_line", "end_line", "signature", "enclosing_name", "kind", "ordinal"])
            yield out.astype({"file_id": "int64", "start_line": "int32", "end_line": "int32", "ordinal": "int32"})

    found = files.select("file_id", "lang", "text").mapInPandas(run, SCHEMA)
    return found.withColumn("symbol_id", F.xxhash64("file_id", "ordinal").bitwiseAND(F.lit((1 << 63) - 1))).drop("ordinal")


CODE = ("bash", "c", "cpp", "csharp", "elixir", "go", "haskell", "java", "javascript", "kotlin", "lua", "php", "ruby", "rust", "scala", "swift", "typescript", "zig")
