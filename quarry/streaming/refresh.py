"""Incremental refresh as Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.refresh import upsert

#: Buckets of a followed state.
BUCKETS = 64


def latest(changes: DataFrame, key: str = "path") -> DataFrame:
    """Of one batch of (key, version, deleted, ...) the last change of each key; one without a version is the first."""
    version = F.coalesce(F.col("version").cast("bigint"), F.lit(-(1 << 63)))
    return changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), version).alias("c")).select("c.*")


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """`state` after a batch: upserts replace rows, deletions remove them."""
    last = latest(changes, key)
    kept = state.join(last.where("deleted").select(key), key, "left_anti")
    return upsert(kept, last.where("not deleted").drop("deleted"), key)


def _state(spark: SparkSession, target: str, before: int | None = None) -> tuple[int | None, dict[int, int]]:
    """(number, version of each bucket) of the latest finished batch, or of the latest before one."""
    try:
        manifest = spark.read.schema("bucket int, version long, batch long").parquet(f"{target}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, {}
    done = manifest if before is None else manifest.where(F.col("batch") < before)
    last = done.agg(F.max("batch").alias("n")).first().n
    # A row for each bucket, of which there is a fixed number; the bucket -1 marks a batch that has none.
    return last, {r.bucket: r.version for r in manifest.where(F.col("batch") == last).collect() if r.bucket >= 0} if last is not None else {}


def _buckets(spark: SparkSession, target: str, versions: dict[int, int], columns: T.StructType) -> DataFrame:
    paths = [f"{target}/state/v={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.schema(columns).parquet(*paths) if paths else spark.createDataFrame([], columns)


def current(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The state that `follow` keeps under `target`, as of its last finished batch; `schema` is the state's own."""
    return _buckets(spark, target, _state(spark, target)[1], T._parse_datatype_string(schema))


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "path", buckets: int = BUCKETS) -> None:
    """Apply all change files that have come since the last call.

    The state lies in buckets of the key's hash.  A batch reads and rewrites only those that hold a key
    of its own, and then writes a manifest of every bucket's version: readers take the last manifest
    (see `current`).  A batch that is run again begins from the manifest before it and writes the same.
    The number of buckets is fixed with the first batch.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    own = T.StructType([f for f in T._parse_datatype_string(schema).fields if f.name not in ("version", "deleted")])
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, number: int) -> None:
        _, versions = _state(spark, target, number)
        changes = batch.withColumn("_bucket", bucket)
        touched = [r[0] for r in changes.select("_bucket").distinct().collect()]  # `buckets` numbers at most
        state = _buckets(spark, target, {b: versions[b] for b in touched if b in versions}, own)
        after = apply_changes(state, batch, key).withColumn("bucket", bucket)
        after.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/state/v={number}")
        held = [r[0] for r in spark.read.schema(T.StructType([*own.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{target}/state/v={number}").select("bucket").distinct().collect()]
        now = {b: v for b, v in versions.items() if b not in touched} | dict.fromkeys(held, number)
        rows = [(b, v) for b, v in sorted(now.items())] or [(-1, number)]
        spark.createDataFrame(rows, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/batch={number}")

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start().awaitTermination()


def event_counts(spark: SparkSession, events: str, folder: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window of event time, from all files there are, by a watermarked stream.

    Written once a window is past the watermark, and at the end for the rest.
    """
    import uuid

    run = f"{folder}/{uuid.uuid4().hex}"
    schema = spark.read.parquet(events).schema
    stream = spark.readStream.schema(schema).parquet(f"{events[:-1]}[{events[-1]}]")  # a pattern may name a file, a plain path only a folder
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{run}/out/b{number}")

    counts.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{run}/state").foreachBatch(keep).start().awaitTermination()
    every = spark.read.parquet(f"{run}/out/*")
    return every.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max_by("n", "batch").alias("n"))
