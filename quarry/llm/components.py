"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.tables import written

#: Every round shortens paths by a constant factor at least, so this many cover any real table.
MOST_ROUNDS = 64


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable.

    `edges` has u and v of one orderable type; loops, repeats and either direction are fine.  Each
    step is a grouped minimum and a join, so a hub's neighbours are never gathered in one row.  An
    empty table gives no rows.
    """
    pairs = lambda e: e.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs(edges))
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(pairs(small))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError("components did not settle")
    star = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return star.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
