"""Symbol tables: definitions, references, listings and counts."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import glob_match

GROUPS = {"name": "name", "lang": "lang", "file": "path", "tag": "tag", "content": "content_type"}


def located(symbol: DataFrame, file: DataFrame) -> DataFrame:
    """Symbols with their file and the name of the definition around them."""
    around = symbol.select(F.col("symbol_id").alias("enclosing_id"), F.col("name").alias("enclosing"))
    return symbol.join(file.select("file_id", "path", "lang", "content_type"), "file_id").join(around, "enclosing_id", "left")


def named(symbol: DataFrame, file: DataFrame, name: str, tag: str, langs: list[str] | None = None) -> DataFrame:
    """All definitions (`def`) or references (`ref`) of a name; no content filter applies."""
    found = symbol.where((F.col("name") == name) & (F.col("tag") == tag))
    out = located_some(found, symbol, file)
    return (out.where(F.col("lang").isin(langs)) if langs else out).orderBy("path", "start_line", "symbol_id")


def located_some(found: DataFrame, symbol: DataFrame, file: DataFrame) -> DataFrame:
    around = symbol.where("tag = 'def'").select(F.col("symbol_id").alias("enclosing_id"), F.col("name").alias("enclosing"))
    return found.join(file.select("file_id", "path", "lang", "content_type"), "file_id").join(around, "enclosing_id", "left")


def scope(langs=(), content=(), include=(), exclude=(), path: Column | None = None) -> Column:
    """Filter by language, category and path globs; an exclusion wins, a null does not match."""
    path = F.col("path") if path is None else path
    parts = [F.lit(True)]
    if langs:
        parts.append(F.col("lang").isin(list(langs)))
    if content:
        parts.append(F.col("content_type").isin(list(content)))
    if include:
        parts.append(reduce(lambda a, b: a | b, [glob_match(path, g) for g in include]))
    parts += [~F.coalesce(glob_match(path, g), F.lit(False)) for g in exclude]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def listed(symbol: DataFrame, file: DataFrame, pattern: str = "*", tag: str | None = None, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """Symbols whose name matches a glob, by path and line; no limit if it is null, 0 or negative."""
    out = located_some(symbol.where(glob_match(F.col("name"), pattern)), symbol, file)
    if tag:
        out = out.where(F.col("tag") == tag)
    if where is not None:
        out = out.where(where)
    out = out.orderBy("path", "start_line", "symbol_id")
    return out.limit(limit) if limit and limit > 0 else out


def counted(symbols: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """(key, n) by falling count, then key."""
    out = symbols.groupBy(F.col(GROUPS[by]).alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")
    return out.limit(limit) if limit and limit > 0 else out


def totals(symbols: DataFrame, by: str) -> DataFrame:
    return symbols.agg(F.countDistinct(GROUPS[by]).alias("groups"), F.count("*").alias("symbols"))


def enclosed(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References with enclosing_id: the first definition of their enclosing name whose lines hold them."""
    d = defs.select("file_id", F.col("name").alias("enclosing_name"), F.col("symbol_id").alias("_id"), F.col("start_line").alias("_a"), F.col("end_line").alias("_b"))
    hit = refs.join(d, ["file_id", "enclosing_name"]).where("start_line between _a and _b").groupBy("symbol_id").agg(F.min("_id").alias("enclosing_id"))
    return refs.join(hit, "symbol_id", "left")


class Around:
    """The shortest of the spans around each of ascending lines, in one sweep.

    Spans are opened in the order of their first lines.  They wait by length, then by key; one that has
    ended is dropped when it comes up.
    """

    def __init__(self) -> None:
        self.waiting: list[tuple] = []

    def open(self, first: int, last: int, key) -> None:
        heapq.heappush(self.waiting, (last - first, key, last))

    def at(self, line: int):
        """The key of the shortest span that holds the line, ties by the least key; None without one."""
        while self.waiting and self.waiting[0][2] < line:
            heapq.heappop(self.waiting)
        return self.waiting[0][1] if self.waiting else None


def innermost(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References with the shortest definition of their file that holds their line (ties: smallest id).

    Both sorts of rows lie in one order of files and lines, and a sweep holds the definitions that are
    open, so no pair of a reference and a definition is ever made.  Without a line or a file there is none.
    """
    line = lambda c: F.col(c).cast("int").alias(c)
    one = refs.select("file_id", line("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(1).alias("kind"), "symbol_id")
    both = one.unionByName(defs.select("file_id", line("start_line"), line("end_line"), F.lit(0).alias("kind"), "symbol_id").where("end_line >= start_line"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, around = object(), Around()
        for b in batches:
            ids, found = [], []
            for f, first, last, kind, i in zip(*(c.to_pylist() for c in b.columns)):
                if f != file:
                    file, around = f, Around()
                if not kind:
                    around.open(first, last, i)
                elif (key := around.at(first)) is not None:
                    ids.append(i)
                    found.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["symbol_id", "enclosing_id"])

    order = ["file_id", "start_line", "kind", "symbol_id"]
    both = both.where("file_id is not null and start_line is not null").repartition("file_id").sortWithinPartitions(*order)
    return refs.join(both.mapInArrow(sweep, "symbol_id bigint, enclosing_id bigint"), "symbol_id", "left")


def exact(queries: DataFrame, symbol: DataFrame, chunk: DataFrame) -> DataFrame:
    """(query_id, chunk_id, path, start_line, score) of chunks that hold a definition named as the query.

    A definition's own chunk, or a window (a chunk of no symbol) over its first line.  The OR of the
    two is a union of two joins, each with an equality to plan on.
    """
    defs = symbol.where("tag = 'def'").select("symbol_id", "file_id", F.col("name").alias("query"), F.col("start_line").alias("at"))
    hit = queries.select("query_id", "query").join(defs, "query")
    cols = ["query_id", "chunk_id", "path", "start_line"]
    own = hit.join(chunk.where("symbol_id is not null"), ["symbol_id"]).select(*cols)
    window = hit.drop("symbol_id").join(chunk.where("symbol_id is null"), "file_id").where("at between start_line and end_line").select(*cols)
    once = own.unionByName(window).groupBy("query_id", "chunk_id").agg(F.min(F.struct("path", "start_line")).alias("p"))
    return once.select("query_id", "chunk_id", "p.path", "p.start_line")


def status(file: DataFrame, symbol: DataFrame, chunk: DataFrame) -> DataFrame:
    """(kind, n) of files, symbols and chunks."""
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(file, "files").unionByName(one(symbol, "symbols")).unionByName(one(chunk, "chunks"))


def top_languages(file: DataFrame, n: int = 5) -> DataFrame:
    return file.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(n)


def by_content(hits: DataFrame) -> DataFrame:
    """(content_type, n) by falling count, ties by first appearance (`position`)."""
    g = hits.groupBy("content_type").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    return g.orderBy(F.desc("n"), "first").select("content_type", "n")
