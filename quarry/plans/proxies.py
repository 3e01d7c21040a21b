"""The driver's tables seen as files, symbols, chunks and queries.

The tables hold prose, not source code, so these are proxies: they exercise the relational
operators, not the parsers.  Each has the same meaning in Spark and, as text, in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import is_prose, is_symbol_query, matches

DIRS = ("core", "tests", "docs/src", "compat", "examples/a", "lib", "_compat/x", "spec", "testing", "attestation", "inspection", "docs_src")
NAMES = ("Widget", "test_io", "helper_test", "README", "Makefile", "app.spec", "HTTPServer_v2", "__init__", "FooTests", "latest", "data", ".bashrc", "BarSpec", "go", "test_helpers")
EXTENSIONS = (".py", ".md", ".swift", ".csv", ".ts", ".toml", ".go", ".d.ts", ".java", "", ".mod", ".tar.gz", ".c", ".rs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(items: tuple[str, ...], key: str):
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.col("doc_id"), F.lit(len(items))) + 1).cast("int")) if key == "" else F.element_at(F.array(*map(F.lit, items)), (F.pmod(F.expr(key), F.lit(len(items))) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: a path made from the id, size in bytes, a made-up mtime."""
    path = F.concat("source", F.lit("/"), _pick(DIRS, ""), F.lit("/"), _pick(NAMES, "doc_id div 3"), _pick(EXTENSIONS, "doc_id div 5"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), path.alias("path"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"),
        (F.col("doc_id") * 1_000_003).alias("mtime_ns"), F.col("lang").alias("human"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


FILES = f"""files AS (
  SELECT doc_id AS file_id, source || '/' || {_list(DIRS)}[doc_id % {len(DIRS)} + 1] || '/' || {_list(NAMES)}[doc_id // 3 % {len(NAMES)} + 1] || {_list(EXTENSIONS)}[doc_id // 5 % {len(EXTENSIONS)} + 1] AS path,
         CAST(coalesce(strlen(text), 0) AS BIGINT) AS size, doc_id * 1000003 AS mtime_ns, lang AS human, coalesce(text, '') AS text
  FROM documents)"""


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line's first word, if capitalised, is a definition up to the next such line; the line's
    other capitalised words are references inside it."""
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "t"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    f = f.withColumn("line", F.col("line") + 1).withColumn("caps", matches(F.col("t"), r"\b[A-Z][a-z]+")).withColumn("defines", F.col("t").rlike(r"\A[A-Z][a-z]+"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("file_id").orderBy("line")
    f = f.withColumn("next", F.min(F.when(F.col("defines"), F.col("line"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    f = f.withColumn("owner", F.last(F.when(F.col("defines"), F.element_at("caps", 1)), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.col("file_id") * 1_000_000_000 + F.col("line") * 10_000
    caps = f.where(F.size("caps") > 0).select("file_id", "line", "lines", "next", "owner", "defines", base.alias("base"), F.posexplode("caps").alias("k", "name"))
    is_def = F.col("defines") & (F.col("k") == 0)
    return caps.select(
        (F.col("base") + F.col("k")).alias("symbol_id"), "file_id", "name", F.when(is_def, "def").otherwise("ref").alias("tag"), F.col("line").alias("start_line"),
        F.when(is_def, F.coalesce(F.col("next") - 1, F.col("lines"))).otherwise(F.col("line")).alias("end_line"),
        F.when(~is_def, F.col("owner")).alias("enclosing_name"),
    )


SYMBOLS = r"""lines AS (
  SELECT doc_id AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line,
         len(string_split(coalesce(text, ''), chr(10))) AS lines FROM documents),
marked AS (SELECT *, regexp_extract_all(t, '\b[A-Z][a-z]+') AS caps, regexp_matches(t, '\A[A-Z][a-z]+') AS defines FROM lines),
spans AS (
  SELECT *, min(CASE WHEN defines THEN line END) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         last_value(CASE WHEN defines THEN caps[1] END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner
  FROM marked),
caps AS (SELECT file_id, line, lines, nxt, owner, defines, unnest(caps) AS name, generate_subscripts(caps, 1) - 1 AS k FROM spans WHERE len(caps) > 0),
symbols AS (
  SELECT file_id * 1000000000 + line * 10000 + k AS symbol_id, file_id, name, CASE WHEN defines AND k = 0 THEN 'def' ELSE 'ref' END AS tag, line AS start_line,
         CASE WHEN defines AND k = 0 THEN coalesce(nxt - 1, lines) ELSE line END AS end_line, CASE WHEN defines AND k = 0 THEN NULL ELSE owner END AS enclosing_name
  FROM caps)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the source stands for the file."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's text as a query.  No join is in it, so plans see how small it is."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return q.withColumn("is_symbol", is_symbol_query(F.col("query"))).withColumn("is_prose", is_prose(F.col("query")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`asked` with the vector whose vec_id is its item_id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return asked(spark, sf_dir).join(v, "query_id", "left")
