"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.tables import written

SHARDS = 16
SEED = 17
#: Slices of the shuffle order and of the interleaved order.  Ranks are taken inside a slice and
#: moved by the slice's offset, so neither a hot source nor the whole table is sorted in one task.
SLICES = 4096


def _offsets(counts: DataFrame, part: list[str], at: str) -> DataFrame:
    """Rows before each slice.  `counts` has a row per slice, not per document."""
    w = Window.orderBy(at) if not part else Window.partitionBy(*part).orderBy(at)
    return counts.withColumn("before", F.sum("n").over(w) - F.col("n"))


def _unit(text: Column) -> Column:
    """[0, 1) from the first 12 hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """doc_id, size, text_crc32, source key, shard and slot for every row.

    Rows are shuffled inside their source by a seeded md5 of doc_id.  Row i of a source of n rows
    has fractional rank (i - phase) / n, phase being the source's own seeded number in [0, 1).  The
    rows sorted by it are cut into `shards` runs whose counts differ by one at most, so each run
    holds every source in proportion.  Equal ids are ordered by checksum and size; rows equal in
    all of these are interchangeable.  A null source is a source of its own; a null text has size 1
    and checksum 0; an empty table gives no rows.  Text never moves: only ids and numbers shuffle.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    idtext = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    small = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        key.alias("src"),
        F.md5(F.concat(F.lit(f"{seed}:"), idtext).cast("binary")).alias("h"),
    ).withColumn("slice", F.floor(F.conv(F.substring("h", 1, 6), 16, 10).cast("bigint") * slices / (1 << 24)))
    small = written(small)
    tie = ["h", "doc_id", "text_crc32", "size"]
    within = _offsets(small.groupBy("src", "slice").agg(F.count("*").alias("n")), ["src"], "slice")
    totals = small.groupBy("src").agg(F.count("*").alias("total"))
    ranked = (
        small.withColumn("i", F.row_number().over(Window.partitionBy("src", "slice").orderBy(*tie)))
        .join(within.join(totals, "src").select("src", "slice", "before", "total"), ["src", "slice"])
        .withColumn("frac", (F.col("i") + F.col("before") - _unit(F.concat(F.lit(f"{seed}:"), F.col("src")).cast("binary"))) / F.col("total"))
        .withColumn("run", F.least(F.floor(F.col("frac") * slices), F.lit(slices - 1)))
        .drop("i", "before", "total", "slice")
    )
    ranked = written(ranked)
    runs = _offsets(ranked.groupBy("run").agg(F.count("*").alias("n")), [], "run").withColumn("rows", F.sum("n").over(Window.partitionBy()))
    placed = (
        ranked.withColumn("j", F.row_number().over(Window.partitionBy("run").orderBy("frac", "src", *tie)))
        .join(runs.select("run", "before", "rows"), "run")
        .withColumn("pos", F.col("j") + F.col("before") - 1)
        .withColumn("shard", F.expr(f"(pos * {shards}) div rows").cast("int"))
    )
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.expr(f"pos - (shard * rows + {shards - 1}) div {shards}").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB SQL of `interleave`; the checksum is the reflected CRC-32 of polynomial 0xEDB88320.
SQL = """
WITH t AS (
  SELECT list(list_reduce([k] || range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS tab
  FROM (SELECT unnest(range(256)) AS k)),
d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
         xor(list_reduce([4294967295] || list_transform(range(1, 2 * coalesce(strlen(text), 0) + 1, 2), lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT)),
             lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
         coalesce('s' || source, 'n') AS src, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM (SELECT *, hex(encode(coalesce(text, ''))) AS digits FROM documents), t),
c AS (
  SELECT src, CAST(('0x' || substr(md5('17:' || src), 1, 12)) AS BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS phase, count(*) AS total
  FROM d GROUP BY src),
f AS (
  SELECT d.*, (row_number() OVER (PARTITION BY src ORDER BY h, doc_id, size) - phase) / total::DOUBLE AS frac
  FROM d JOIN c USING (src)),
p AS (SELECT *, row_number() OVER (ORDER BY frac, src, h, doc_id, size) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 16 // n AS INTEGER) AS shard,
       CAST(pos - ((pos * 16 // n) * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
