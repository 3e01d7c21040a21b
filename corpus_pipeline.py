"""A corpus pipeline of five stages, each calling one operator of quarry.llm.

STAGES are applied in order; each result is written as Parquet and read again as the next stage's
documents.  All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, jaccard, langid, substrings
from quarry.llm.queries import tokenizer_file
from quarry.llm.tables import removed, shared_folder, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: shingles of five words, similarity of 80 / 100 or more.
SHINGLE, NEAR, OF = 5, 80, 100


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model can name: those without a letter go.

    The model learns from the labelled rows of the stage's own input, as the query op2 does.  Without
    any to learn from, documents that have a letter stay.
    """
    out = langid.held_out(F.col("doc_id"), 3, 1)
    model = langid.fit(docs, ~out)
    if model is None:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    labelled = langid.identify(docs.select(*COLUMNS), model)
    return labelled.where(F.col("lang_pred") != langid.UND).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id, null ids last.

    Rows are told apart by a key of their own: of rows that repeat an id in one group, one (any)
    stays.  Documents without words stay.
    """
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))
    groups = jaccard.join(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE, NEAR, OF)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = groups.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier in the corpus.

    A text that loses nothing stays as it is; one that loses all its words goes.
    """
    cut = substrings.dedup(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate, each row judged by its own text.

    A null text and an empty one have no words and stay, as does every row where the benchmark is empty;
    rows that repeat stay or go together.
    """
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and the digests of ids and decoded text, of every row; a null text counts as empty."""
    return bpe.digest(docs, tokenizer_file())


def _stage(step):
    """A stage: when it begins, the result of the one before is stored, so that one's own tables go."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        removed(spark)
        return step(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", _stage(identify)),
    ("jaccard_join", _stage(near_duplicates)),
    ("substring_dedup", _stage(repeated_passages)),
    ("decontamination", _stage(decontaminated)),
    ("bpe", _stage(tokens)),
]

#: Classifier, tokenizer and digests cannot be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
