"""The ranking of a search: tiers into one score, boosts and penalties, the best with diversity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import fusion, lexical, rerank
from quarry.operators.rerank import COHERENCE, DECAY, DEFINITION, STEM


class Ranking(NamedTuple):
    """How a search ranks; the settings' names and defaults."""

    ranker: str = "rrf"
    adaptive_alpha: bool = True
    alpha_prose: float = fusion.ALPHA_PROSE
    alpha_symbol: float = fusion.ALPHA_SYMBOL
    rerank: bool = True
    file_coherence: float = COHERENCE
    stem_boost: float = STEM
    definition_boost: float = DEFINITION
    saturation_decay: float = DECAY
    #: Whether path penalties apply: to a search for code, and to one that names no content.
    penalties: bool = True
    #: Places that scores are rounded to after each step; None leaves them.
    digits: int | None = None


def ranked(tiers: DataFrame, queries: DataFrame, held: DataFrame, k: int, by: Ranking = Ranking()) -> DataFrame:
    """(query_id, chunk_id, path, rank, score) of the k best, the first of each query having score 1.

    `tiers` has (query_id, tier, chunk_id, rank, raw), `queries` query, is_symbol and is_prose, `held` the
    chunks that may be found (chunk_id, path, text), of which boosts may add some that no tier found.
    """
    even = (lambda c: c) if by.digits is None else lambda c: c.withColumn("score", F.round("score", by.digits))
    fused = fusion.first_tier(tiers) if by.ranker == "none" else fusion.reciprocal_rank(tiers, fusion.weights(queries, by.adaptive_alpha, by.alpha_prose, by.alpha_symbol))
    c = fusion.min_max(fused).select("query_id", "chunk_id", "score")
    if by.rerank:
        c = even(rerank.coherence(rerank.judged(c, queries, held), by.file_coherence))
        c = even(rerank.boosts(c, queries, held, by.stem_boost, by.definition_boost))
        if by.penalties:
            c = even(rerank.penalised(c))
        best = rerank.saturate(c, k, by.saturation_decay)
    else:
        # Only chunks that are held may be found.
        best = lexical.top(c.join(held.select("chunk_id", "path"), "chunk_id"), k).withColumn("effective", F.col("score"))
    return rerank.rescaled(best).select("query_id", "chunk_id", "path", "rank", F.col("final").alias("score"))
