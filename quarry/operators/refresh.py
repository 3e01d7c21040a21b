"""Incremental refresh: snapshot diff and the writes that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def diff(walked: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): added, deleted, changed or same; any difference of time or size is a change."""
    w = walked.select("path", F.col("mtime_ns").alias("wm"), F.col("size").alias("ws"), F.lit(True).alias("w"))
    k = known.select("path", F.col("mtime_ns").alias("km"), F.col("size").alias("ks"), F.lit(True).alias("k"))
    same = F.col("wm").eqNullSafe(F.col("km")) & F.col("ws").eqNullSafe(F.col("ks"))
    state = F.when(F.col("k").isNull(), "added").when(F.col("w").isNull(), "deleted").when(~same, "changed").otherwise("same")
    return w.join(k, "path", "full_outer").select("path", state.alias("state"))


def report(states: DataFrame) -> DataFrame:
    of = lambda s: F.count(F.when(F.col("state") == s, 1)).alias(s)
    return states.agg(of("added"), of("changed"), of("deleted"))


def upsert(known: DataFrame, incoming: DataFrame, key: str = "path") -> DataFrame:
    """Known rows with incoming ones in their place; of incoming rows of one key the last `version` counts."""
    rows = known.withColumn("_v", F.lit(-1).cast("bigint")).unionByName(incoming.withColumn("_v", F.col("version").cast("bigint")).drop("version"))
    w = Window.partitionBy(key).orderBy(F.desc("_v"))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_v")


def without(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the keys that stay: a deleted file's symbols and chunks go with it."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def replaced(rows: DataFrame, fresh: DataFrame, keys: DataFrame, key: str = "path") -> DataFrame:
    """All rows of the named keys replaced by the fresh ones."""
    return without(rows, keys, key).unionByName(fresh.join(keys.select(key).distinct(), key, "left_semi").select(*rows.columns))
