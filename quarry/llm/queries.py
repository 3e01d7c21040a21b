"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import alignment, blocknames, bpe, decontaminate, fingerprints, jaccard, langid, repair, shards, substrings, suffixtree, toxicity, urlfilter
from quarry.llm.arrowtext import documents


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.pages_judged(spark, sf_dir)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.interleave(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(documents(spark, sf_dir))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), tokenizer_file())


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(documents(spark, sf_dir))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir), digest=True)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.digest(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filters": urlfilter.SQL,
        "op4_decontamination": decontaminate.SQL,
        "op5_sharding": shards.SQL,
        "op9_substring_dedup": substrings.SQL,
        "op10_jaccard_join": jaccard.SQL,
        "op12_exact_dedup": blocknames.SQL,
        "op13_conversation_repair": repair.SQL,
    }
