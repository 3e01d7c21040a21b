"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import NOT_ALNUM, small_batches, split_words, text_chunks

WINDOW = 13
#: UTF-8 bytes of benchmark text in one automaton; a larger benchmark is cut into several.
AUTOMATON_BYTES = 4 << 20

#: A-Z to a-z, bytes outside a word to a space; byte positions do not move.
_NORMAL = bytes(32 if NOT_ALNUM[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, words array<struct<first:int,last:int>>, spans array<struct<start:int,stop:int>>"
#: Automata that a Python worker has built, by run and part: those of the latest run only.
_BUILT: dict[tuple[str, int], ahocorasick.Automaton | None] = {}


def normalise(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split() if text else []


def windows(text: str | None, size: int = WINDOW) -> set[bytes]:
    w = normalise(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def _automaton(patterns: dict[bytes, list[str]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p, items in patterns.items():
        out.add_word(" " + p.decode("latin-1") + " ", (p.count(b" ") + 1, items))
    out.make_automaton()
    return out


def _parts(benchmark: DataFrame, size: int, limit: int) -> Iterator[dict[bytes, list[str]]]:
    """The benchmark's windows in dictionaries of a bounded size, read row by row."""
    part: dict[bytes, list[str]] = {}
    held = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        for w in windows(r.text, size):
            if r.item_id not in (have := part.setdefault(w, [])):
                have.append(r.item_id)
        held += len(r.text.encode("utf-8", "replace"))
        if held >= limit:
            yield part
            part, held = {}, 0
    yield part


def _scanner(docs: DataFrame, benchmark: DataFrame, window: int, limit: int) -> Callable[[list, pa.Array], list[dict]]:
    """A function of doc_ids and texts, for workers, that gives a row of `_SCHEMA` for each."""
    spark = docs.sparkSession
    small_batches(spark)
    run = uuid.uuid4().hex
    parts = [spark.sparkContext.broadcast(p) for p in _parts(benchmark, window, limit)]

    def scan(ids: list, texts: pa.Array) -> list[dict]:
        built = []
        for i, p in enumerate(parts):
            if (key := (run, i)) not in _BUILT:
                for old in [k for k in _BUILT if k[0] != run]:
                    del _BUILT[old]
                _BUILT[key] = _automaton(p.value) if p.value else None
            built.append(_BUILT[key])
        built = [a for a in built if a is not None and len(a)]
        out = []
        for first, raw, off in text_chunks(texts):
            data = raw.tobytes().translate(_NORMAL)
            for r in range(len(off) - 1):
                out.append(_document(ids[first + r], data[off[r] : off[r + 1]], built))
        return out

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per document row: n_words, n_hit, the items found, hit word ranges and byte spans.

    A window is `window` consecutive words of one item; an item of fewer words is one window.  A
    document word inside any occurrence is hit.  `spans` are byte offsets into the UTF-8 text as it
    was given.  Null and empty texts have no words; repeated doc_ids stay separate rows; a null or
    empty item is ignored, and items that share an id count once.  An empty benchmark hits nothing.
    A benchmark of over `limit` bytes is scanned for by several automata, each broadcast on its own.
    """
    scan = _scanner(docs, benchmark, window, limit)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist(scan(b.column(0).to_pylist(), b.column(1)), schema=_ARROW)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(rows, _SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The input rows, with their columns, that the benchmark does not contaminate: each by its own text."""
    scan = _scanner(docs, benchmark, window, limit)
    base = docs.withColumn("text", F.col("text").cast("string"))
    at = base.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan([None] * b.num_rows, b.column(at))
            yield b.filter(pa.array([not contaminated(r["n_hit"], r["n_words"]) for r in found], pa.bool_()))

    return base.mapInArrow(rows, base.schema)


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("words", _RANGE), ("spans", _SPAN)])


def _document(doc_id: int | None, data: bytes, built: list) -> dict:
    words = data.split()
    row = {"doc_id": doc_id, "n_words": len(words), "n_hit": 0, "items": [], "words": [], "spans": []}
    if not words:
        return row
    line = " " + b" ".join(words).decode("latin-1") + " "
    found = [(end, n, items) for a in built for end, (n, items) in a.iter(line)]
    if not found:
        return row
    starts, ends, _ = split_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), NOT_ALNUM)
    after = np.cumsum(ends - starts + 1)  # where the space behind each word lies in `line`
    last = np.searchsorted(after, [end for end, _, _ in found])
    hit = np.zeros(len(words) + 1, np.int64)
    np.add.at(hit, last + 1, -1)
    np.add.at(hit, last + 1 - np.array([n for _, n, _ in found]), 1)
    covered = np.concatenate([[0], np.cumsum(hit[:-1]) > 0, [0]]).astype(np.int8)
    a, b = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1) - 1
    row["n_hit"] = int(covered.sum())
    row["items"] = sorted({i for _, _, items in found for i in items})
    row["words"] = [{"first": int(x), "last": int(y)} for x, y in zip(a, b)]
    row["spans"] = [{"start": int(starts[x]), "stop": int(ends[y])} for x, y in zip(a, b)]
    return row


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract columns of `contamination` with production parameters."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * 20 >= n_words)


#: DuckDB SQL of `digest`.  Windows are compared as joined words.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
dw AS (
  SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT dw.rid, dw.i, dw.n, p.item_id FROM dw JOIN p ON dw.win = p.win AND dw.n = p.n),
hits AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM m) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""
