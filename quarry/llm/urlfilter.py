"""Temporal URL lists: dated entries become validity intervals, captures are judged as of their fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Days of one slice of time.  Intervals and captures meet inside a slice, so the captures of a hot
#: host are spread over as many join keys as they span slices.
SLICE_DAYS = 30
_DAY = 86_400


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(host: Column, path: Column, labels: int, segments: int) -> Column:
    """What a list may name for a page: the host's suffixes, and host plus leading path segments.

    Keys have up to `labels` labels or `segments` segments: as many as the list's own longest have.
    """
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(segments))), lambda k: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, k), "/")))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(suffixes, F.slice(prefixes, 2, segments)))).otherwise(F.array().cast("array<string>"))


def longest(entries: DataFrame) -> tuple[int, int]:
    """(labels of a host, segments of a path) that the list's longest keys have: two numbers for the driver."""
    host, steps = F.substring_index("key", "/", 1), F.size(F.split("key", "/")) - 1
    r = entries.where("key is not null").agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.max(steps).alias("segments")).first()
    return r.labels or 0, r.segments or 0


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, since, until): an entry holds from its date until the key's next one.

    `entries` has key, dated (timestamp) and action: `block`, `allow` or `remove`; a removal ends
    the entry before it and holds nothing itself.  Of entries of one key and date the last action
    in alphabetical order counts; rows with a null key, date or action are ignored.  The last
    interval is open: `until` is null.
    """
    once = entries.where(F.col("key").isNotNull() & F.col("dated").isNotNull() & F.col("action").isNotNull())
    once = once.groupBy(F.lower("key").alias("key"), "dated").agg(F.max("action").alias("action"))
    until = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    return once.select("key", "action", F.col("dated").alias("since"), until.alias("until")).where("action <> 'remove'")


def judge(captures: DataFrame, entries: DataFrame, slice_days: int = SLICE_DAYS) -> DataFrame:
    """Every capture with the entry that was active when it was fetched.

    `captures` has page_id, url, fetched_at.  The longest active key wins (a path counts as longer
    than any host, a longer host suffix than a shorter one); `blocked` says whether it blocks.  A
    capture without an active entry, without a host (null or malformed url) or without a fetch time
    is not blocked and has null entry columns.  Repeated captures stay repeated; an empty list
    blocks nothing.  Other columns of captures are left out, so none can clash.
    """
    span = captures.agg(F.min("fetched_at").alias("a"), F.max("fetched_at").alias("b")).first()
    slot = lambda t: F.floor(F.unix_timestamp(t) / (slice_days * _DAY))
    url = F.coalesce("url", F.lit(""))
    once = captures.groupBy("page_id", "url", "fetched_at").agg(F.count("*").alias("times"))
    once = once.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    if span.a is None:
        span = ("1970-01-01", "1970-01-01")
    kind = captures.schema["fetched_at"].dataType
    low, high = (slot(F.lit(t).cast(kind)) for t in span)
    active = intervals(entries).withColumn("slot", F.explode(F.filter(F.sequence(F.greatest(slot("since"), low), F.greatest(F.least(F.coalesce(slot("until"), high), high), F.greatest(slot("since"), low))), lambda s: s <= high)))
    wanted = once.where("fetched_at is not null").select("page_id", "url", "fetched_at", slot("fetched_at").alias("slot"), F.explode(keys_of(F.col("host"), F.col("path"), *longest(entries))).alias("key"))
    met = wanted.join(active, ["key", "slot"]).where((F.col("fetched_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until"))))
    rank = F.struct(F.instr("key", "/") > 0, F.length("key"), "key", "action", "since", "until")
    best = met.groupBy("page_id", "url", "fetched_at").agg(F.max(rank).alias("e")).select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched_at").alias("_f"), "e")
    out = once.join(best, F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & F.col("fetched_at").eqNullSafe(F.col("_f")), "left")
    return out.select(
        "page_id", "url", "host", "fetched_at", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"),
        F.col("e.key").alias("entry"), F.col("e.action").alias("action"), F.col("e.since").alias("active_since"), F.col("e.until").alias("active_until"),
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy"),
    ).drop("_copy")


#: The pages table has neither fetch times nor a list: both are derived by these rules.
FIRST_DAY, DAYS = "TIMESTAMP_NTZ'2020-01-01 00:00:00'", 1461


def _time(days: str, seconds: str = "0") -> Column:
    return F.expr(f"{FIRST_DAY} + make_dt_interval(CAST({days} AS INT), 0, 0, {seconds})")


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch time: a day of 2020-2023 by the page id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", _time(f"pmod(page_id * 7919, {DAYS})", f"pmod(page_id * 31, {_DAY})").alias("fetched_at"))


def host_list(captures: DataFrame) -> DataFrame:
    """Dated entries for the hosts seen: every third by md5 is blocked, half of those removed and
    blocked again later, and one path of every fifth host allowed; all `.org` pages are blocked for
    one year."""
    hosts = captures.select(host_of(F.coalesce("url", F.lit(""))).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("bigint"))
    row = lambda key, d, action: F.struct(key.alias("key"), _time(d).alias("dated"), F.lit(action).alias("action"))
    h, host = F.col("h"), F.col("host")
    entries = F.filter(
        F.array(
            F.when(h % 3 == 0, row(host, "h % 700", "block")),
            F.when(h % 6 == 0, row(host, "h % 700 + 200", "remove")),
            F.when(h % 6 == 0, row(host, "h % 700 + 500", "block")),
            F.when(h % 5 == 0, row(F.concat(host, F.lit("/en")), "h % 900", "allow")),
        ),
        lambda e: e.isNotNull(),
    )
    zone = captures.sparkSession.createDataFrame([("org", 366, "block"), ("org", 731, "remove")], "key string, d int, action string")
    return hosts.select(F.explode(entries).alias("e")).select("e.*").unionByName(zone.select("key", _time("d").alias("dated"), "action"))


def pages_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = page_captures(spark, sf_dir)
    return judge(captures, host_list(captures))


#: DuckDB SQL of `pages_judged`.
SQL = r"""
WITH c AS (
  SELECT page_id, url, make_timestamp((1577836800 + (page_id * 7919 % 1461) * 86400 + page_id * 31 % 86400) * 1000000) AS fetched_at,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS parts
  FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM c WHERE host <> '')),
l AS (
  SELECT host AS key, h % 700 AS d, 'block' AS action FROM h WHERE h % 3 = 0
  UNION ALL SELECT host, h % 700 + 200, 'remove' FROM h WHERE h % 6 = 0
  UNION ALL SELECT host, h % 700 + 500, 'block' FROM h WHERE h % 6 = 0
  UNION ALL SELECT host || '/en', h % 900, 'allow' FROM h WHERE h % 5 = 0
  UNION ALL SELECT 'org', 366, 'block' UNION ALL SELECT 'org', 731, 'remove'),
i AS (
  SELECT key, action, make_timestamp((1577836800 + d * 86400) * 1000000) AS since,
         make_timestamp((1577836800 + lead(d) OVER (PARTITION BY key ORDER BY d) * 86400) * 1000000) AS until
  FROM (SELECT key, d, max(action) AS action FROM l GROUP BY key, d)),
k AS (
  SELECT page_id, url, fetched_at, host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(list_slice(string_split(host, '.'), len(string_split(host, '.')) - n + 1, len(string_split(host, '.'))), '.'))) AS key FROM c WHERE host <> ''
  UNION ALL
  SELECT page_id, url, fetched_at, host, unnest(list_transform(range(1, len(parts) + 1), lambda n: host || '/' || array_to_string(list_slice(parts, 1, n), '/'))) AS key FROM c WHERE host <> '' AND len(parts) > 0),
m AS (
  SELECT k.page_id, k.key, i.action, i.since, i.until, row_number() OVER (PARTITION BY k.page_id ORDER BY k.key LIKE '%/%' DESC, length(k.key) DESC) AS n
  FROM k JOIN i ON k.key = i.key AND i.action <> 'remove' AND k.fetched_at >= i.since AND (i.until IS NULL OR k.fetched_at < i.until))
SELECT c.page_id, c.url, c.host, c.fetched_at, coalesce(m.action = 'block', false) AS blocked, m.key AS entry, m.action, m.since AS active_since, m.until AS active_until
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.n = 1
"""
