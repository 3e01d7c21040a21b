"""Ranked tiers into one score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rank offset of reciprocal-rank fusion.
OFFSET = 60
TIERS = ("exact", "lexical", "vector")
ALPHA_PROSE, ALPHA_SYMBOL = 0.5, 0.3


def ranked(tier: DataFrame, name: str) -> DataFrame:
    """(query_id, tier, chunk_id, rank, raw) by (score desc, chunk_id)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return tier.select("query_id", F.lit(name).alias("tier"), "chunk_id", F.row_number().over(w).alias("rank"), F.col("score").cast("double").alias("raw"))


def weights(queries: DataFrame, adaptive: bool = True, prose: float = ALPHA_PROSE, symbol: float = ALPHA_SYMBOL) -> DataFrame:
    """(query_id, tier, weight); `queries` has is_prose."""
    alpha = F.when(F.col("is_prose"), prose).otherwise(symbol) if adaptive else F.lit(0.5)
    each = F.array(
        F.struct(F.lit("exact").alias("tier"), F.lit(1.0).alias("weight")),
        F.struct(F.lit("vector").alias("tier"), alpha.alias("weight")),
        F.struct(F.lit("lexical").alias("tier"), (1 - alpha).alias("weight")),
    )
    return queries.select("query_id", F.explode(each).alias("w")).select("query_id", "w.*")


def reciprocal_rank(tiers: DataFrame, weight: DataFrame, digits: int = 9) -> DataFrame:
    """(query_id, chunk_id, fused): the sum of weight / (60 + rank); tiers of weight 0 do not count."""
    part = tiers.join(weight.where("weight <> 0"), ["query_id", "tier"])
    return part.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (OFFSET + F.col("rank"))), digits).alias("fused"))


def first_tier(tiers: DataFrame) -> DataFrame:
    """(query_id, chunk_id, fused): the first tier that found anything, by its raw scores."""
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    w = Window.partitionBy("query_id")
    return tiers.withColumn("o", order).withColumn("m", F.min("o").over(w)).where("o = m").select("query_id", "chunk_id", F.col("raw").alias("fused"))


def min_max(scored: DataFrame, digits: int = 9) -> DataFrame:
    """`score` in [0, 1] within each query; 1 if all are equal."""
    w = Window.partitionBy("query_id")
    low, high = F.min("fused").over(w), F.max("fused").over(w)
    return scored.withColumn("score", F.round(F.when(high == low, F.lit(1.0)).otherwise((F.col("fused") - low) / (high - low)), digits))


def evidence(tiers: DataFrame) -> DataFrame:
    """(query_id, chunk_id, tiers): tier to raw score, in tier order."""
    order = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    rows = tiers.groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "tier", "raw"))).alias("e"))
    return rows.select("query_id", "chunk_id", F.map_from_entries(F.transform("e", lambda e: F.struct(e["tier"], e["raw"]))).alias("tiers"))
