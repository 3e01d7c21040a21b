"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; without one, a temporary one in local mode (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
        spark.conf.set("spark.checkpoint.dir", named) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(named)
    return named


#: Tables that this process has written and not removed yet.
_MADE: list[str] = []


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quarry-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession) -> None:
    """Remove the tables that `written` has made so far: for when the results that read them are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _MADE:
        path = hadoop(_MADE.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """(rows, UTF-8 bytes of all texts): two numbers for the driver."""
    r = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)).alias("b")).first()
    return r.n, r.b
