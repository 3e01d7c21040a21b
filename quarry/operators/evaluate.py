"""Retrieval quality and table comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that end a word, a random number for each byte, and an odd one.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTE = np.random.default_rng(11).integers(1 << 64, size=256, dtype=np.uint64)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Texts whose words are hashed at once.
IN_BATCH = 256


def path_match(a: Column, b: Column) -> Column:
    """Equal, or one a suffix of the other at a slash."""
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))


def covers(hit_path: Column, hit_a: Column, hit_b: Column, path: Column, a: Column, b: Column) -> Column:
    """The paths match and the spans overlap; a label without a span asks for the path alone."""
    return path_match(hit_path, path) & (a.isNull() | ((hit_a <= F.coalesce(b, a)) & (hit_b >= a)))


def ndcg(hits: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg): gain of the distinct ranks at which labels are first covered, over the ideal.

    `hits` has query_id, rank, key; `labels` has query_id, key: a hit covers the labels of its key.
    """
    first = labels.distinct().join(hits.where(F.col("rank") <= k), ["query_id", "key"], "left").groupBy("query_id", "key").agg(F.min("rank").alias("rank"))
    # One pass over the labels, which may be costly: a query's ranks are k at most.
    of = first.groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"), F.sort_array(F.collect_set("rank")).alias("ranks"))
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return of.select("query_id", (gain(F.col("ranks")) / gain(F.sequence(F.lit(1), F.col("n")))).alias("ndcg"))


def runs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From batches (key, text): (key, h), a hash of every `size` words `[^\\x20\\x09-\\x0D]+` in a row; equal runs have equal ones.

    A text's bytes are hashed where they lie: no string is made of a word or of a run.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, IN_BATCH):
                some = b.slice(a, IN_BATCH)
                word, many = _words(some.column(1).cast(pa.large_string()))
                held = np.maximum(many - size + 1, 0)
                # A run's first word: its place among its text's runs, after the words of the texts before.
                first = np.arange(held.sum()) + np.repeat(np.cumsum(many) - many - np.cumsum(held) + held, held)
                h = np.zeros(len(first), np.uint64)
                for i in range(size):
                    h = (h ^ word[first + i]) * MULTIPLIER
                    h ^= h >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(np.repeat(np.arange(len(many)), held))), pa.array(h.view(np.int64))], names=[b.schema.names[0], "h"])

    return of


def _words(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word, words of each text); a null text has none."""
    _, offsets, data = text.buffers()
    off = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    inner = ~SPACE[raw]
    begin = inner.copy()
    begin[1:] &= ~inner[:-1]
    edge = off[off < len(raw)]
    begin[edge] = inner[edge]
    many = np.diff(np.searchsorted(np.flatnonzero(begin), off))
    at = np.flatnonzero(inner)
    lead = np.flatnonzero(begin[at])
    if not len(lead):
        return np.zeros(0, np.uint64), many
    length = np.diff(np.append(lead, len(at)))
    power = np.cumprod(np.full(length.max(), MULTIPLIER))
    value = BYTE[raw[at]] * power[np.arange(len(at)) - np.repeat(lead, length)]
    return np.add.reduceat(value, lead), many


def recall(hits: DataFrame, labels: DataFrame, at: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of queries with a labelled key among the first ranks."""
    best = labels.distinct().join(hits, ["query_id", "key"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return best.agg(*[F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0)).alias(f"recall_{n}") for n in at])


def latency(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """p50 and p95 of a column: the sorted values at n / 2 and int(0.95 n)."""
    w = Window.partitionBy(*by)
    rn = F.row_number().over(w.orderBy(value)) - 1
    t = times.select(*by, F.col(value).alias("v"), rn.alias("i"), F.count("*").over(w).alias("n"))
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("v")))
    return t.groupBy(*by).agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.floor(F.col("n") * F.lit(0.95))).alias("p95"))


def bag_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, copies counted: (side, ...)."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
