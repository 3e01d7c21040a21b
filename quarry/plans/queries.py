"""Registered queries of the engine's own operators, each with DuckDB SQL of the same meaning."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import windows
from quarry.functions import classify, text
from quarry.operators import chunks as ch
from quarry.operators import evaluate, fusion, lexical, postings, refresh, rerank, search, symbols, vectors
from quarry.plans import proxies as px

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- lexical, vector and fused search --------------------------------------------------------

#: Words of the index and of the queries, BM25 and its 30 best chunks, as CTEs.
_STOP = ", ".join(f"'{w}'" for w in text.QUERY_STOP)
_LEXICAL = rf"""tok AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}]+')) AS term FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY ALL),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avgdl),
ident AS (SELECT item_id AS query_id, raw, pos FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS raw, generate_subscripts(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), 1) AS pos FROM benchmark)),
qt AS (SELECT query_id, lower(raw) AS term, count(*) AS qtf FROM ident WHERE length(raw) > 2 AND lower(raw) NOT IN ({_STOP}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5e0) / (df + 0.5e0)) > 0 THEN ln((n - df + 0.5e0) / (df + 0.5e0)) ELSE 1e-6 END AS idf FROM df, st),
bm AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 30)"""
_VECTOR = """vec AS (
  SELECT b.item_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings v),
vtop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec QUALIFY rank <= 30)"""
_FUSED = """prose AS (SELECT item_id AS query_id, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) >= 4 AS prose FROM benchmark),
tiers AS (SELECT query_id, 'lexical' AS tier, chunk_id, rank, score AS raw FROM lex UNION ALL SELECT query_id, 'vector', chunk_id, rank, score FROM vtop),
fused AS (
  SELECT query_id, chunk_id, round(sum(CASE WHEN tier = 'lexical' THEN 1 - a ELSE a END / (60 + rank)), 9) AS f
  FROM (SELECT t.*, CASE WHEN prose THEN 0.5e0 ELSE 0.3e0 END AS a FROM tiers t JOIN prose USING (query_id)) GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id, source AS path, coalesce(text, '') AS text,
         round(CASE WHEN max(f) OVER q = min(f) OVER q THEN 1e0 ELSE (f - min(f) OVER q) / (max(f) OVER q - min(f) OVER q) END, 9) AS score
  FROM fused JOIN documents ON doc_id = chunk_id WINDOW q AS (PARTITION BY query_id)),
co AS (
  SELECT *, max(score) OVER (PARTITION BY query_id) AS top, sum(score) OVER (PARTITION BY query_id, path) AS fs,
         row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS pr FROM scored),
boosted AS (
  SELECT query_id, chunk_id, path, text, round(score + CASE WHEN pr = 1 AND top > 0 THEN top * 0.2e0 * fs / max(fs) OVER (PARTITION BY query_id) ELSE 0 END, 9) AS score FROM co),
sat AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn,
         row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) - 1 AS n,
         CASE WHEN text <> '' THEN row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, chunk_id) - 1 ELSE 0 END AS rep FROM boosted),
eff AS (SELECT *, score * pow(0.5e0, n + rep) AS eff FROM sat),
flo AS (SELECT *, coalesce(min(eff) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS fl FROM eff),
stp AS (SELECT *, max(CASE WHEN rn - 1 >= 10 AND score <= fl THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM flo),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, chunk_id) AS rank FROM stp WHERE ended = 0 QUALIFY rank <= 10)"""


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.best(px.asked(spark, sf_dir), lexical.prepared(px.chunks(spark, sf_dir)), digits=6, keep=_stored)


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = px.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return vectors.nearest(px.queries(spark, sf_dir), stored)


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.ranked(_lexical(spark, sf_dir), "lexical").unionByName(fusion.ranked(_vector(spark, sf_dir), "vector"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.reciprocal_rank(_tiers(spark, sf_dir), fusion.weights(px.asked(spark, sf_dir)))


@query(f"WITH {_LEXICAL} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM lex WHERE rank <= 10")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark text."""
    return _lexical(spark, sf_dir).where("rank <= 10").select("query_id", "chunk_id", "rank", "score")


@query(SQL["bm25_search"])
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_search over a prepared index of postings, lengths and statistics."""
    index = lexical.prepared(px.chunks(spark, sf_dir))
    return lexical.best(px.asked(spark, sf_dir), index, 10, 6, keep=_stored).select("query_id", "chunk_id", "rank", "score")


@query(SQL["bm25_search"])
def pruned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_search over a stored index of which only the buckets and groups needed are read."""
    index = postings.build(px.chunks(spark, sf_dir), f"{_scratch(spark)}/postings-{uuid.uuid4().hex}")
    return postings.search(px.asked(spark, sf_dir), index, 10, digits=6).select("query_id", "chunk_id", "rank", "score")


@query(r"""WITH tok AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM tok GROUP BY term""")
def keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and corpus frequency of every term of the keyword index."""
    return lexical.postings(px.chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("""SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) WHERE rank <= 30""")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 nearest vectors of every vector whose id is divisible by 20."""
    v = px.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    return vectors.nearest(q, v).select("query_id", "chunk_id", "rank", "score")


@query("""WITH u AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, embedding FROM embeddings)
SELECT vec_id, round(n, 6) AS norm, round(embedding[1]::DOUBLE / n, 6) AS first, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE / n) * (x::DOUBLE / n))), 6) AS square FROM u""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms and unit vectors."""
    v = px.table(spark, sf_dir, "embeddings").withColumn("u", vectors.unit(F.col("embedding")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("square"))


@query(f"WITH {_LEXICAL}, {_VECTOR}, {_FUSED} SELECT query_id, chunk_id, path, CAST(rank AS INTEGER) AS rank, round(CASE WHEN max(eff) OVER (PARTITION BY query_id) > 0 THEN eff / max(eff) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM best")
def fused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tiers fused, coherence, saturation, top ten, rescaled, hydrated."""
    c = fusion.min_max(_fused(spark, sf_dir)).join(rerank.digested(px.chunks(spark, sf_dir)), "chunk_id").select("query_id", "chunk_id", "path", "text", "score")
    c = rerank.coherence(c).withColumn("score", F.round("score", 9))
    return rerank.rescaled(rerank.saturate(c, 10)).select("query_id", "chunk_id", "path", "rank", F.round("final", 6).alias("score"))


@query(f"WITH {_LEXICAL}, {_VECTOR}, {_FUSED} SELECT query_id, chunk_id, f AS fused FROM fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted reciprocal-rank fusion of the lexical and vector tiers."""
    return _fused(spark, sf_dir)


@query(f"""WITH {_LEXICAL}, s AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER q = min(score) OVER q THEN 1e0 ELSE (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) END AS s FROM lex WINDOW q AS (PARTITION BY query_id))
SELECT query_id, chunk_id, round(s, 9) AS score FROM s""")
def first_tier_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """no fusion, the first tier that found anything, min-max scaled."""
    return fusion.min_max(fusion.first_tier(_tiers(spark, sf_dir))).select("query_id", "chunk_id", "score")


@query(f"WITH {_LEXICAL}, {_VECTOR}, {_FUSED} SELECT query_id, chunk_id, max(CASE WHEN tier = 'lexical' THEN raw END) AS lexical, max(CASE WHEN tier = 'vector' THEN raw END) AS vector, count(*) AS tiers FROM tiers GROUP BY ALL")
def tier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what each tier said of a candidate."""
    e = fusion.evidence(_tiers(spark, sf_dir))
    return e.select("query_id", "chunk_id", F.col("tiers")["lexical"].alias("lexical"), F.col("tiers")["vector"].alias("vector"), F.size("tiers").cast("bigint").alias("tiers"))


_RELEVANT = r"""iw AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT item_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark) WHERE len(w) >= 8)),
dw AS (
  SELECT doc_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) >= 8)),
lab AS (SELECT DISTINCT item_id AS query_id, doc_id AS key FROM iw JOIN dw USING (g))"""


@query(f"""WITH {_LEXICAL}, {_VECTOR}, {_FUSED},
{_RELEVANT},
firsts AS (SELECT lab.query_id, lab.key, min(rank) AS rank FROM lab LEFT JOIN best ON best.query_id = lab.query_id AND best.chunk_id = lab.key GROUP BY ALL),
dcg AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT DISTINCT query_id, rank FROM firsts WHERE rank IS NOT NULL) GROUP BY ALL),
n AS (SELECT query_id, least(count(*), 10) AS n FROM lab GROUP BY ALL)
SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM n LEFT JOIN dcg USING (query_id)""")
def search_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG@10 of the fused search; a document is relevant if it holds eight words of an item in a row."""
    return evaluate.ndcg(_hits(spark, sf_dir), _relevant(spark, sf_dir)).withColumn("ndcg", F.round("ndcg", 6))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_search(spark, sf_dir).select("query_id", "rank", F.col("chunk_id").alias("key"))


def _word_windows(rows: DataFrame, key: str) -> DataFrame:
    """(key, h): a hash of every run of eight words of `text`."""
    return rows.select(F.col(key).cast("bigint").alias(key), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(evaluate.runs(8), f"{key} bigint, h bigint")


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant for an item if any eight consecutive words of the item occur in it."""
    item = _word_windows(px.table(spark, sf_dir, "benchmark"), "item_id").distinct()
    found = _word_windows(px.table(spark, sf_dir, "documents"), "doc_id").join(item, "h")
    return found.select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("key")).distinct()


@query(f"""WITH {_LEXICAL}, {_VECTOR}, {_FUSED},
{_RELEVANT},
m AS (SELECT lab.query_id, min(rank) AS rank FROM lab LEFT JOIN best ON best.query_id = lab.query_id AND best.chunk_id = lab.key GROUP BY ALL)
SELECT round(avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END), 6) AS recall_1, round(avg(CASE WHEN rank <= 3 THEN 1e0 ELSE 0e0 END), 6) AS recall_3 FROM m""")
def search_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 1 and 3 of the fused search."""
    return evaluate.recall(_hits(spark, sf_dir), _relevant(spark, sf_dir)).select(F.round("recall_1", 6).alias("recall_1"), F.round("recall_3", 6).alias("recall_3"))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')[1:6]) AS w FROM benchmark),
n AS (SELECT DISTINCT item_id AS query_id, w[1:2] || '_' || w[4:] AS name FROM w)
SELECT query_id, name, page_id FROM n JOIN pages ON lower(url) LIKE '%' || name || '%'""")
def paths_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose address is LIKE a name with a wildcard in it."""
    words = F.explode(F.slice(text.matches(F.lower("text"), "[a-z]{4,}"), 1, 6))
    names = px.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w"))
    names = names.select("query_id", F.concat(F.substring("w", 1, 2), F.lit("_"), F.expr("substring(w, 4)")).alias("_n")).distinct()
    pages = px.table(spark, sf_dir, "pages").select(F.col("url").alias("path"), "page_id")
    found = rerank.paths_like(pages.select("path").distinct(), names)
    return found.join(pages, "path").select("query_id", F.col("_n").alias("name"), "page_id")


@query(r"""WITH e AS (SELECT vec_id, embedding, count(*) OVER () AS n FROM embeddings),
t AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{L}\p{N}]+') AS ws FROM documents)),
k AS (SELECT doc_id, i, CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % (2 * (SELECT count(*) FROM embeddings)) AS id FROM t),
h AS (SELECT doc_id, embedding::DOUBLE[] AS row, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM k JOIN e ON vec_id = id),
d AS (SELECT doc_id, unnest(row) AS x, generate_subscripts(row, 1) AS j FROM h WHERE nth <= 512),
s AS (SELECT doc_id, j, avg(x) AS x FROM d GROUP BY ALL),
v AS (SELECT doc_id, j, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS x FROM s)
SELECT doc_id, j AS dim, round(x, 5) AS x FROM v WHERE j <= 8""")
def lookup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as means of the table rows that their words are led to; half of the words lead to none."""
    e = px.table(spark, sf_dir, "embeddings")
    docs = px.table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.broadcast(e.agg((2 * F.count("*")).alias("n")))  # one row
    words = docs.select(F.explode(lexical.tokens(F.col("text"))).alias("token")).distinct().join(n, F.lit(True))
    id_ = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    table = words.withColumn("vec_id", id_).join(e, "vec_id").select("token", F.col("embedding").alias("row"))
    made = vectors.pooled(docs, "text", table, 64).where(F.exists("vec", lambda x: x != 0))
    out = made.select("doc_id", F.posexplode("vec").alias("dim", "x")).where("dim < 8")
    return out.select("doc_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("x", 5).alias("x"))


# --- boosts ----------------------------------------------------------------------------------

_HEADS = ("class ", "def ", "the ", "CREATE TABLE ", "create view ", "fn ns::", "module a.b.", "data class ", "x class", "reclass ")
_TAILS = ("(", " x", ":", ";", "x", "", "[", "<T>")
_PART = f"""cand AS (
  SELECT p_partkey AS chunk_id, 'lib/' || CASE WHEN p_partkey % 4 = 0 THEN 'name' || (p_partkey % 9) ELSE 'other' END || CASE WHEN p_partkey % 8 = 0 THEN 's' ELSE '' END || '.py' AS path,
         'head' || chr(10) || {px._list(_HEADS)}[p_partkey % {len(_HEADS)} + 1] || 'Name' || (p_partkey % 9) || {px._list(_TAILS)}[p_partkey // 7 % {len(_TAILS)} + 1] AS text FROM part)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part rows as chunks that may declare Name0 to Name8."""
    k, pick = F.col("p_partkey"), lambda items, key: F.element_at(F.array(*map(F.lit, items)), (F.expr(key) % len(items) + 1).cast("int"))
    path = F.concat(F.lit("lib/"), F.when(k % 4 == 0, F.concat(F.lit("name"), k % 9)).otherwise("other"), F.when(k % 8 == 0, "s").otherwise(""), F.lit(".py"))
    body = F.concat(F.lit("head\n"), pick(_HEADS, "p_partkey"), F.lit("Name"), k % 9, pick(_TAILS, "p_partkey div 7"))
    return px.table(spark, sf_dir, "part").select(k.alias("chunk_id"), path.alias("path"), body.alias("text"))


@query(rf"""WITH {_PART}, q AS (SELECT unnest(range(9)) AS query_id), j AS (
  SELECT query_id, chunk_id, path,
         regexp_matches(text, '(?m)(?:^|\s)(?:class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef)\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*Name' || query_id || '(?:\s|[<({{:\[;]|$)')
         OR regexp_matches(text, '(?mi)(?:^|\s)(?:CREATE TABLE|CREATE VIEW|CREATE PROCEDURE|CREATE FUNCTION)\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*Name' || query_id || '(?:\s|[<({{:\[;]|$)') AS declares,
         rtrim(regexp_extract(path, '([^/]*)\.py$', 1), 's') = 'name' || query_id AS named FROM cand, q)
SELECT query_id, chunk_id, CASE WHEN named THEN 4.5e0 ELSE 3e0 END AS bonus FROM j WHERE declares""")
def definition_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the bonus of every chunk that declares a queried name."""
    q = spark.range(9).select(F.col("id").alias("query_id"), F.array(F.concat(F.lit("Name"), "id")).alias("names"))
    c = _candidates(spark, sf_dir).join(F.broadcast(q), F.lit(True))
    return c.select("query_id", "chunk_id", rerank.named_bonus(F.col("text"), F.col("path"), F.col("names"), F.lit(3.0)).alias("bonus")).where("bonus > 0")


_ASKS = ("how does the widget server parse data", "HTTPServer", "where are tests for io", "readme of core lib", "find latest foo tests", "app spec", "helper")


_ASKED = ", ".join(f"({i}, {px._list(tuple(dict.fromkeys(w.lower() for w in re.findall('[A-Za-z_][A-Za-z0-9_]*', a) if len(w) > 2 and w.lower() not in text.PATH_STOP)))})" for i, a in enumerate(_ASKS))
_SPLIT = r"CASE WHEN contains(x, '_') THEN list_filter(string_split(lower(x), '_'), lambda s: s <> '') ELSE list_transform(regexp_extract_all(regexp_replace(x, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda s: lower(s)) END"


@query(rf"""WITH {px.FILES}, q(query_id, words) AS (VALUES {_ASKED}),
p AS (SELECT DISTINCT path FROM files),
seg AS (SELECT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '^(.+)\.[^.]+$', '\1') AS x FROM p UNION ALL SELECT path, regexp_extract(path, '([^/]+)/[^/]+$', 1) FROM p),
cut AS (SELECT path, lower(x) AS whole, {_SPLIT} AS parts FROM seg WHERE x <> ''),
bag AS (SELECT path, list_distinct(flatten(list(CASE WHEN len(parts) >= 2 THEN list_concat([whole], parts) ELSE [whole] END))) AS parts FROM cut GROUP BY path),
r AS (SELECT query_id, path, len(list_filter(words, lambda k: list_contains(parts, k) OR len(list_filter(parts, lambda s: least(length(k), length(s)) >= 3 AND (starts_with(s, k) OR starts_with(k, s)))) > 0))::DOUBLE / len(words) AS ratio FROM bag, q)
SELECT query_id, path, round(ratio, 6) AS ratio FROM r WHERE ratio >= 0.1e0""")
def stem_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """share of a query's words that a path accounts for."""
    q = spark.createDataFrame([(i, s) for i, s in enumerate(_ASKS)], "query_id int, query string")
    paths = px.files(spark, sf_dir).select("path").distinct()
    return paths.join(F.broadcast(q), F.lit(True)).select("query_id", "path", F.round(rerank.stem_ratio(F.col("query"), F.col("path")), 6).alias("ratio")).where(F.col("ratio") >= 0.10)


@query(f"""WITH RECURSIVE {px.FILES}, base AS (SELECT file_id AS chunk_id, file_id % 7 AS query_id, path, text, round((file_id * 37 % 101)::DOUBLE / 100, 6) AS score FROM files),
sat AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn,
         row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) - 1 AS n,
         CASE WHEN text <> '' THEN row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, chunk_id) - 1 ELSE 0 END AS rep FROM base),
eff AS (SELECT *, score * pow(0.5e0, n + rep) AS eff FROM sat),
flo AS (SELECT *, coalesce(min(eff) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS fl FROM eff),
stp AS (SELECT *, max(CASE WHEN rn - 1 >= 50 AND score <= fl THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM flo)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(eff, 6) AS effective FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, chunk_id) AS rank FROM stp WHERE ended = 0) WHERE rank <= 50""")
def saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, L4: the greedy top 50 with decay, over seven made-up rankings of all documents."""
    f = px.files(spark, sf_dir)
    c = f.select(F.col("file_id").alias("chunk_id"), (F.col("file_id") % 7).alias("query_id"), "path", "text", F.round((F.col("file_id") * 37 % 101) / 100, 6).alias("score"))
    return rerank.saturate(rerank.reachable(rerank.digested(c), 50), 50).select("query_id", "chunk_id", "rank", F.round("effective", 6).alias("effective"))


# --- the whole search ------------------------------------------------------------------------

#: Words before a declared name.
_DECLARING = "class|module|defmodule|def|interface|struct|enum|trait|type|func|function|object|abstract class|data class|fn|fun|package|namespace|protocol|record|typedef"
#: Documents as chunks: a third declare their first word, a fifth are tests, a file is named for its first capitalised word.
_WHOLE = rf"""w AS (SELECT doc_id, coalesce(source, 's') AS source, coalesce(text, '') AS t, lower(regexp_extract(coalesce(text, ''), '[A-Z][a-z]+')) AS word FROM documents),
ch AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'tests' ELSE source END AS parent, CASE WHEN word = '' THEN 'none' ELSE word END AS stem,
         source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE '' END || CASE WHEN word = '' THEN 'none' ELSE word END || '.py' AS path, CASE WHEN doc_id % 3 = 0 THEN 'class ' || t ELSE t END AS text
  FROM w),
q AS (SELECT item_id * 2 + 1 AS item_id, text, false AS sym FROM benchmark UNION ALL SELECT item_id * 2, regexp_extract(text, '[A-Z][a-z]+'), true FROM benchmark),
{_LEXICAL.replace("FROM benchmark", "FROM q").replace("FROM documents", "FROM ch")},
{_VECTOR.replace("b.item_id AS query_id", "b.item_id * 2 + 1 AS query_id")},
{px.SYMBOLS},
ex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM (SELECT DISTINCT q.item_id AS query_id, s.file_id AS chunk_id FROM q JOIN symbols s ON s.tag = 'def' AND s.name = q.text)),
fu AS (
  SELECT query_id, chunk_id, round(sum(CASE WHEN tier = 'exact' THEN 1 WHEN tier = 'vector' THEN a ELSE 1 - a END / (60 + rank)), 9) AS f
  FROM (SELECT query_id, 'lexical' AS tier, chunk_id, rank FROM lex UNION ALL SELECT query_id, 'vector', chunk_id, rank FROM vtop UNION ALL SELECT query_id, 'exact', chunk_id, rank FROM ex) t
  JOIN (SELECT item_id, sym, CASE WHEN sym THEN 0.3e0 ELSE 0.5e0 END AS a FROM q) ON item_id = query_id GROUP BY ALL),
mm AS (
  SELECT query_id, chunk_id, round(CASE WHEN max(f) OVER q = min(f) OVER q THEN 1e0 ELSE (f - min(f) OVER q) / (max(f) OVER q - min(f) OVER q) END, 9) AS score
  FROM fu WINDOW q AS (PARTITION BY query_id)),
sc AS (SELECT query_id, chunk_id, path, text, score FROM mm JOIN ch ON doc_id = chunk_id),
co AS (
  SELECT *, max(score) OVER (PARTITION BY query_id) AS top, sum(score) OVER (PARTITION BY query_id, path) AS fs, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) AS pr FROM sc),
ci AS (SELECT query_id, chunk_id, path, text, round(score + CASE WHEN pr = 1 AND top > 0 THEN top * 0.2e0 * fs / max(fs) OVER (PARTITION BY query_id) ELSE 0 END, 9) AS score FROM co),
words AS (SELECT item_id, list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: length(x) > 2), lambda x: lower(x)), lambda x: NOT list_contains(string_split('{" ".join(text.PATH_STOP)}', ' '), x))) AS ks FROM q),
sides AS (
  SELECT doc_id, stem, lower(text) AS low, [stem, parent] || CASE WHEN regexp_matches(parent, '[0-9]') THEN regexp_extract_all(parent, '[a-z]+|[0-9]+') ELSE [] END AS ps FROM ch),
tops AS (SELECT query_id, max(score) AS top FROM ci GROUP BY query_id),
near AS (
  SELECT item_id AS query_id, doc_id AS chunk_id, path, c.text, 0e0 AS score, top
  FROM q JOIN tops ON query_id = item_id JOIN ch c ON lower(c.path) LIKE '%' || lower(q.text) || '%' WHERE sym AND top > 0 AND length(q.text) >= 3
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY doc_id) <= 200),
al AS (
  SELECT query_id, chunk_id, path, text, score, top, false AS added FROM ci JOIN tops USING (query_id)
  UNION ALL SELECT *, true FROM near WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.query_id = near.query_id AND ci.chunk_id = near.chunk_id)),
gain AS (
  SELECT al.*, CASE WHEN top <= 0 THEN 0 WHEN sym THEN
      CASE WHEN regexp_matches(al.text, '(?m)(?:^|\s)(?:{_DECLARING})\s+(?:[A-Za-z_][A-Za-z0-9_]*(?:\.|::))*' || q.text || '(?:\s|[<(' || chr(123) || ':\[;]|$)')
           THEN top * 3e0 * CASE WHEN s.stem = lower(q.text) OR rtrim(s.stem, 's') = lower(q.text) THEN 1.5e0 ELSE 1 END ELSE 0 END
    ELSE (SELECT CASE WHEN r < 0.10e0 THEN 0 ELSE top * r END FROM (SELECT CASE WHEN len(ks) > 0 THEN len(list_filter(ks, lambda k: len(list_filter(ps, lambda p: p = k OR (least(length(k), length(p)) >= 3 AND (starts_with(p, k) OR starts_with(k, p))))) > 0)) / len(ks)::DOUBLE ELSE 0 END AS r)) END AS g
  FROM al JOIN q ON q.item_id = query_id JOIN words ON words.item_id = query_id JOIN sides s ON s.doc_id = chunk_id),
base AS (
  SELECT query_id, chunk_id, path, text, round(round(score + g, 9) * CASE WHEN path LIKE '%/tests/%' THEN 0.3e0 ELSE 1 END, 9) AS score FROM gain WHERE NOT added OR g <> 0),
sat AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rn, row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_id) - 1 AS n,
         CASE WHEN text <> '' THEN row_number() OVER (PARTITION BY query_id, text ORDER BY score DESC, chunk_id) - 1 ELSE 0 END AS rep FROM base),
eff AS (SELECT *, score * pow(0.5e0, n + rep) AS eff FROM sat),
flo AS (SELECT *, coalesce(min(eff) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'infinity'::DOUBLE) AS fl FROM eff),
stp AS (SELECT *, max(CASE WHEN rn - 1 >= 10 AND score <= fl THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM flo),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, chunk_id) AS rank FROM stp WHERE ended = 0 QUALIFY rank <= 10),
plain AS (SELECT query_id, chunk_id, path, score AS eff, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc QUALIFY rank <= 10)"""
_OUT = "SELECT query_id, chunk_id, path, CAST(rank AS INTEGER) AS rank, round(CASE WHEN max(eff) OVER (PARTITION BY query_id) > 0 THEN eff / max(eff) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score FROM"


def _whole(spark: SparkSession, sf_dir: str, by: search.Ranking) -> DataFrame:
    body, first = F.coalesce("text", F.lit("")), F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Z][a-z]+", 0))
    path = F.concat(F.coalesce("source", F.lit("s")), F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "tests/").otherwise(""), F.when(first == "", "none").otherwise(first), F.lit(".py"))
    held = px.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), path.alias("path"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("class "), body)).otherwise(body).alias("text"), F.size(F.split(body, "\n")).alias("end_line"))
    held = held.withColumns({"symbol_id": F.lit(None).cast("bigint"), "start_line": F.lit(1)})
    asked, even = px.asked(spark, sf_dir), (F.col("query_id") * 2).alias("query_id")
    odd = (F.col("query_id") * 2 + 1).alias("query_id")
    prose, names = asked.select(odd, "query"), asked.select(even, F.regexp_extract("query", "[A-Z][a-z]+", 0).alias("query"))
    q = prose.unionByName(names).withColumn("is_symbol", text.is_symbol_query(F.col("query"))).withColumn("is_prose", text.is_prose(F.col("query")))
    exact = symbols.exact(q, px.symbols(spark, sf_dir), held).withColumn("score", F.lit(1.0))
    words = lexical.best(q, lexical.prepared(held), digits=6, keep=_stored)
    stored = px.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    tiers = fusion.ranked(exact, "exact").unionByName(fusion.ranked(words, "lexical")).unionByName(fusion.ranked(vectors.nearest(px.queries(spark, sf_dir).select(odd, "vec"), stored), "vector"))
    best = search.ranked(_stored(tiers), q, held, 10, by)
    return best.select("query_id", "chunk_id", "path", "rank", F.round("score", 6).alias("score"))


def _stored(df: DataFrame) -> DataFrame:
    """A table that several branches read, written once."""
    folder = f"{_scratch(df.sparkSession)}/once-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query(f"WITH {_WHOLE} {_OUT} best")
def whole_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tiers, coherence, boosts, added chunks, penalties and saturation, for names and prose."""
    return _whole(spark, sf_dir, search.Ranking(digits=9))


@query(f"WITH {_WHOLE} {_OUT} plain")
def unranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the fused order alone, without reranking."""
    return _whole(spark, sf_dir, search.Ranking(rerank=False, digits=9))


# --- classification and text -----------------------------------------------------------------

#: Languages of the names and endings that the tables' paths have.
_LANG_SQL = """CASE WHEN name = 'Makefile' THEN 'make' WHEN name = 'go.mod' THEN 'gomod' WHEN ext = '.py' THEN 'python' WHEN ext = '.md' THEN 'markdown' WHEN ext = '.swift' THEN 'swift'
  WHEN ext = '.csv' THEN 'csv' WHEN ext = '.ts' THEN 'typescript' WHEN ext = '.toml' THEN 'toml' WHEN ext = '.go' THEN 'go' WHEN ext = '.java' THEN 'java' WHEN ext = '.c' THEN 'c' WHEN ext = '.rs' THEN 'rust' END"""
_CLASSES = rf"""{px.FILES}, named AS (
  SELECT *, regexp_extract(path, '([^/]+)$', 1) AS name, regexp_extract(regexp_replace(regexp_extract(path, '([^/]+)$', 1), '^\.+', ''), '(\.[^.]+)$', 1) AS ext FROM files),
langs AS (SELECT *, {_LANG_SQL} AS lang,
  regexp_matches(path, '(?i)(?:^|/)__?(?:test|spec)s?__?(?:/|$)|(?:^|/)(?:test|spec)(?:s|ing)?(?:/|$)|(?:^|/|[_.\-])(?:test|spec)s?[_.\-]|[_.\-](?:test|spec)s?\.[A-Za-z0-9]+$')
  OR regexp_matches(path, '[a-z0-9](?:Test|Spec)s?\.[A-Za-z0-9]+$') AS is_test FROM named),
typed AS (SELECT *, CASE WHEN lang = 'markdown' THEN 'docs' WHEN lang IN ('toml', 'make', 'gomod') THEN 'config' WHEN lang = 'csv' THEN 'data' WHEN is_test THEN 'tests' ELSE 'code' END AS content_type FROM langs)"""


@query(rf"""WITH {_CLASSES} SELECT file_id, path, lang, content_type, is_test, round(
  CASE WHEN regexp_matches(path, '(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*_test\.go|[^/]*Tests?\.java|[^/]*Test\.php|[^/]*_spec\.rb|[^/]*_test\.rb|[^/]*\.test\.[jt]sx?|[^/]*\.spec\.[jt]sx?|[^/]*Tests?\.kt|[^/]*Spec\.kt|[^/]*Tests?\.swift|[^/]*Spec\.swift|[^/]*Tests?\.cs|test_[^/]*\.cpp|[^/]*_test\.cpp|test_[^/]*\.c|[^/]*_test\.c|[^/]*Spec\.scala|[^/]*Suite\.scala|[^/]*Test\.scala|[^/]*_test\.dart|test_[^/]*\.dart|[^/]*_spec\.lua|[^/]*_test\.lua|test_[^/]*\.lua|test_helpers?[^/]*\.\w+)$') OR regexp_matches(path, '(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)') THEN 0.3e0 ELSE 1 END
  * CASE WHEN name IN ('__init__.py', 'package-info.java') THEN 0.5e0 ELSE 1 END * CASE WHEN regexp_matches(path, '(?:^|/)(?:compat|_compat|legacy)(?:/|$)') THEN 0.3e0 ELSE 1 END
  * CASE WHEN regexp_matches(path, '(?:^|/)(?:_?examples?|docs?_src)(?:/|$)') THEN 0.3e0 ELSE 1 END * CASE WHEN regexp_matches(path, '\.d\.ts$') THEN 0.7e0 ELSE 1 END, 6) AS penalty FROM typed""")
def classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, category, test mark and penalty of every path."""
    f = classify.with_language(px.files(spark, sf_dir).select("file_id", "path"))
    return f.select("file_id", "path", "lang", classify.content_type(F.col("lang"), F.col("path")).alias("content_type"), classify.is_test(F.col("path")).alias("is_test"), F.round(classify.path_penalty(F.col("path")), 6).alias("penalty"))


@query(rf"""WITH {_CLASSES}, ok AS (SELECT * FROM typed WHERE lang IS NOT NULL AND lang <> 'pem' AND size <= 5000),
once AS (SELECT *, row_number() OVER (PARTITION BY file_id // 2 ORDER BY path) AS r FROM ok)
SELECT o.file_id, o.path, o.lang, o.content_type FROM ok o JOIN (SELECT file_id // 2 AS k, min(path) AS path FROM ok GROUP BY 1) m ON o.path = m.path WHERE o.content_type <> 'data' AND o.file_id // 2 IN (SELECT file_id // 2 FROM ok)
GROUP BY ALL""")
def indexable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known languages, size, one path per real path, excluded categories."""
    f = px.files(spark, sf_dir).select("file_id", "path", "size", F.expr("file_id div 2").alias("real_path"))
    return classify.indexable(f, max_bytes=5000).select("file_id", "path", "lang", "content_type")


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
p AS (SELECT doc_id, i, strlen(line) AS n, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS past, count(*) OVER (PARTITION BY doc_id) AS many FROM l),
s AS (SELECT t.doc_id, strlen(text) AS size, coalesce(list(n ORDER BY n) FILTER (i < many AND past <= 65536), []) AS n FROM t LEFT JOIN p USING (doc_id) GROUP BY t.doc_id, text)
SELECT doc_id, size >= 16384 AND (len(n) < 3 OR coalesce(n[len(n) // 2 + 1], 0) > 1000) AS generated FROM s""")
def generated_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few or very long lines in the first 65,536 bytes, for every document."""
    d = px.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", classify.looks_generated(F.col("text")).alias("generated"))


@query(rf"""WITH {px.FILES}, s AS (SELECT file_id, path, translate(path, '/.', '  ') AS t FROM files),
m AS (SELECT *, regexp_replace(t, '([A-Z])([A-Z][a-z])', '\1 \2', 'g') AS u FROM s)
SELECT file_id, array_to_string(regexp_extract_all(u, '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), ' ') AS words, regexp_extract(path, '([^/]+)$', 1) AS name,
       regexp_replace(regexp_extract(path, '([^/]+)$', 1), '^(.+)\.[^.]+$', '\1') AS stem, regexp_extract(path, '([^/]+)/[^/]+$', 1) AS parent FROM m""")
def path_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Humanised paths, names, stems, parents."""
    p = F.col("path")
    return px.files(spark, sf_dir).select("file_id", text.humanise(p).alias("words"), text.path_name(p).alias("name"), text.path_stem(p).alias("stem"), text.path_parent(p).alias("parent"))


@query(f"""WITH w AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS raw FROM benchmark)
SELECT query_id, lower(raw) AS term, count(*) AS qtf FROM w WHERE length(raw) > 2 AND lower(raw) NOT IN ({_STOP}) GROUP BY ALL""")
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: content words of every query, with multiplicity."""
    return px.asked(spark, sf_dir).select("query_id", F.explode(text.query_terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@query(r"""SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, '')) AS chars, strlen(coalesce(text, '')) AS bytes, substr(coalesce(text, ''), 1, 12) AS head FROM documents""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash, code points, bytes, prefix."""
    t = F.coalesce("text", F.lit(""))
    return px.table(spark, sf_dir, "documents").select("doc_id", text.content_hash(t).alias("content_hash"), F.char_length(t).cast("bigint").alias("chars"), F.octet_length(t).cast("bigint").alias("bytes"), F.substring(t, 1, 12).alias("head"))


# --- chunks ----------------------------------------------------------------------------------

_WINDOWS = r"""ln AS (
  SELECT doc_id AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
g AS (
  SELECT file_id, line, t, strlen(t) + 1 AS size, 0 AS grp FROM ln WHERE line = 1
  UNION ALL
  SELECT l.file_id, l.line, l.t, CASE WHEN g.size >= 750 THEN strlen(l.t) + 1 ELSE g.size + strlen(l.t) + 1 END, CASE WHEN g.size >= 750 THEN g.grp + 1 ELSE g.grp END
  FROM g JOIN ln l ON l.file_id = g.file_id AND l.line = g.line + 1),
win AS (SELECT file_id, grp, min(line) AS start_line, max(line) AS end_line, string_agg(t, chr(10) ORDER BY line) AS text FROM g GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_WINDOWS} SELECT file_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(text) AS body FROM win")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines in groups of 750 bytes or more."""
    return ch.line_windows(px.files(spark, sf_dir)).select("file_id", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("body"))


_SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ENDS = r"\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}"


@query(rf"""WITH RECURSIVE ln AS (
  SELECT doc_id, i, t, length(t) AS n, regexp_full_match(t, '{_SPACE}*') AS blank, coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p
  FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^{_ENDS}]*(?:\r\n|[{_ENDS}])|[^{_ENDS}]+') AS ls FROM documents))),
step AS (
  SELECT l.doc_id, 1::BIGINT AS i, 0::BIGINT AS start, false AS cut, CASE WHEN n > 750 THEN p + n ELSE 0 END AS after, blank FROM ln l WHERE i = 1
  UNION ALL
  SELECT l.doc_id, l.i, s.after, l.p > s.after AND ((s.blank AND NOT l.blank AND l.p - s.after >= 375) OR l.p - s.after + l.n > 750),
         CASE WHEN l.n > 750 THEN l.p + l.n WHEN l.p > s.after AND ((s.blank AND NOT l.blank AND l.p - s.after >= 375) OR l.p - s.after + l.n > 750) THEN l.p ELSE s.after END, l.blank
  FROM step s JOIN ln l ON l.doc_id = s.doc_id AND l.i = s.i + 1),
span AS (
  SELECT doc_id, start AS a, p AS b FROM step JOIN ln USING (doc_id, i) WHERE cut
  UNION ALL
  SELECT doc_id, p + k * 750, least(p + (k + 1) * 750, p + n) FROM (SELECT *, unnest(range(0, (n + 749) // 750)) AS k FROM ln WHERE n > 750)
  UNION ALL
  SELECT s.doc_id, s.after, p + n FROM step s JOIN ln l USING (doc_id, i) WHERE p + n > s.after AND i = (SELECT max(i) FROM ln m WHERE m.doc_id = s.doc_id)),
body AS (SELECT doc_id, a, b, text, substr(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS t FROM span JOIN documents USING (doc_id))
SELECT doc_id AS file_id, CAST(1 + a - length(replace(substr(text, 1, CAST(a AS BIGINT)), chr(10), '')) AS INTEGER) AS start_line,
       CAST(b - length(replace(substr(text, 1, CAST(b - 1 AS BIGINT)), chr(10), '')) AS INTEGER) AS end_line, md5(t) AS body
FROM body WHERE length(regexp_replace(t, '^{_SPACE}+|{_SPACE}+$', '', 'g')) >= 60""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut by blank lines, at any of ten line ends."""
    files = px.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.lit("").alias("path"), F.lit(None).cast("string").alias("lang"), "text")
    return windows.windows(files, lines=False).select("file_id", "start_line", "end_line", F.md5("text").alias("body"))


@query()
def tree_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut along the tree of their elements."""
    files = px.table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.lit("html").alias("lang"), F.col("html").alias("text"))
    return windows.windows(files).select("file_id", "start_line", "end_line", F.md5("text").alias("body"))


@query(f"""WITH RECURSIVE {_WINDOWS}, {px.SYMBOLS},
cov AS (SELECT DISTINCT file_id, unnest(range(start_line, end_line + 1)) AS line FROM symbols WHERE tag = 'def'),
w AS (SELECT file_id, start_line, end_line, unnest(range(start_line, end_line + 1)) AS line FROM win),
s AS (SELECT w.file_id, start_line, end_line, count(*) AS n, count(cov.line) AS c FROM w LEFT JOIN cov ON cov.file_id = w.file_id AND cov.line = w.line GROUP BY ALL)
SELECT file_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM s WHERE (n - c) * 2 >= n""")
def hybrid_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows at least half outside the definitions."""
    defs = px.symbols(spark, sf_dir).where("tag = 'def'")
    return ch.uncovered(ch.line_windows(px.files(spark, sf_dir)), defs).select("file_id", "start_line", "end_line")


@query(f"""WITH {px.SYMBOLS}, c AS (
  SELECT symbol_id, start_line, least(end_line, start_line + 199) AS end_line, array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), start_line, least(end_line, start_line + 199)), chr(10)) AS body
  FROM symbols JOIN documents ON doc_id = file_id WHERE tag = 'def')
SELECT symbol_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(body) AS body FROM c WHERE length(body) BETWEEN 60 AND 20000""")
def definition_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per definition, within bounds."""
    defs = px.symbols(spark, sf_dir).where("tag = 'def'").drop("path")
    return ch.definition_chunks(defs, px.files(spark, sf_dir)).select("symbol_id", "start_line", "end_line", F.md5(F.col("text").cast("binary")).alias("body"))


@query("""WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id // 10 END AS symbol_id, doc_id * 7 % 1000003 AS position FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY position) AS n FROM c) SELECT chunk_id, symbol_id FROM r WHERE symbol_id IS NULL OR n = 1""")
def claimed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk that claims a symbol keeps it."""
    d = px.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 3 != 0, F.expr("doc_id div 10")).alias("symbol_id"), (F.col("doc_id") * 7 % 1_000_003).alias("position"))
    return ch.claimed_once(d).select("chunk_id", "symbol_id")


@query(r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)
SELECT doc_id, md5(array_to_string(regexp_extract_all(regexp_replace(translate(source, '/.', '  '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), ' ') || chr(10) || text) AS whole,
       md5(array_to_string(regexp_extract_all(regexp_replace(translate(source, '/.', '  '), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), ' ') || chr(10) || substr(text, 1, 2000)) AS capped FROM t""")
def lexical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the keyword index would hold, whole and capped."""
    c = px.chunks(spark, sf_dir)
    md5 = lambda x: F.md5(x.cast("binary"))
    return c.select(F.col("chunk_id").alias("doc_id"), md5(ch.lexical_text(F.col("path"), F.col("text"))).alias("whole"), md5(ch.lexical_text(F.col("path"), F.col("text"), "capped")).alias("capped"))


# --- symbols ---------------------------------------------------------------------------------


def _symbols(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = px.files(spark, sf_dir).select("file_id", "path", F.col("human").alias("lang"), F.lit("docs").alias("content_type"))
    s = px.symbols(spark, sf_dir)
    return s.withColumn("enclosing_id", F.lit(None).cast("bigint")), f


@query(f"WITH {px.SYMBOLS}, {px.FILES} SELECT symbol_id, path, name, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line FROM symbols JOIN files USING (file_id) WHERE name = 'The' AND tag = 'def'")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All definitions of a name."""
    s, f = _symbols(spark, sf_dir)
    return symbols.named(s, f, "The", "def").select("symbol_id", "path", "name", "start_line", "end_line")


@query(f"""WITH {px.SYMBOLS}, {px.FILES}, e AS (
  SELECT r.symbol_id, min(d.symbol_id) AS enclosing_id FROM symbols r JOIN symbols d ON d.tag = 'def' AND d.file_id = r.file_id AND d.name = r.enclosing_name AND r.start_line BETWEEN d.start_line AND d.end_line WHERE r.tag = 'ref' GROUP BY ALL)
SELECT r.symbol_id, path, CAST(r.start_line AS INTEGER) AS start_line, e.enclosing_id, d.name AS enclosing FROM symbols r JOIN files USING (file_id) LEFT JOIN e ON e.symbol_id = r.symbol_id LEFT JOIN symbols d ON d.symbol_id = e.enclosing_id WHERE r.tag = 'ref' AND r.name = 'The'""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of a name, with the definition around each."""
    s, f = _symbols(spark, sf_dir)
    s = s.drop("enclosing_id")
    defs = s.where("tag = 'def'")
    whole = symbols.enclosed(s.where("tag = 'ref'"), defs).unionByName(defs.withColumn("enclosing_id", F.lit(None).cast("bigint")))
    return symbols.named(whole, f, "The", "ref").select("symbol_id", "path", "start_line", "enclosing_id", "enclosing")


@query(f"""WITH {px.SYMBOLS}, d AS (SELECT * FROM symbols WHERE tag = 'def'),
c AS (SELECT r.symbol_id, d.symbol_id AS enclosing_id, row_number() OVER (PARTITION BY r.symbol_id ORDER BY d.end_line - d.start_line, d.symbol_id) AS n FROM symbols r JOIN d ON d.file_id = r.file_id AND r.start_line BETWEEN d.start_line AND d.end_line WHERE r.tag = 'ref')
SELECT r.symbol_id, c.enclosing_id FROM symbols r LEFT JOIN c ON c.symbol_id = r.symbol_id AND c.n = 1 WHERE r.tag = 'ref'""")
def innermost_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest definition that contains a reference."""
    s = px.symbols(spark, sf_dir)
    return symbols.innermost(s.where("tag = 'ref'"), s.where("tag = 'def'")).select("symbol_id", "enclosing_id")


@query(f"""WITH {px.SYMBOLS}, {px.FILES} SELECT symbol_id, path, name, tag FROM symbols JOIN files USING (file_id)
WHERE name GLOB 'Th*e' AND path GLOB '*/[cl]*' AND NOT path GLOB '*.md' AND human IN ('en', 'de')""")
def symbol_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by name glob, path globs with an exclusion, language."""
    s, f = _symbols(spark, sf_dir)
    where = symbols.scope(langs=("en", "de"), include=("*/[cl]*",), exclude=("*.md",))
    return symbols.listed(s, f, "Th*e", where=where).select("symbol_id", "path", "name", "tag")


@query(f"""WITH {px.SYMBOLS}, {px.FILES}, t AS (SELECT name, human, tag, path FROM symbols JOIN files USING (file_id))
SELECT 'name' AS by, name AS key, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'lang', human, count(*) FROM t GROUP BY ALL
UNION ALL SELECT 'tag', tag, count(*) FROM t GROUP BY ALL UNION ALL SELECT 'file', path, count(*) FROM t GROUP BY ALL""")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: grouped counts by name, language, tag and file."""
    s, f = _symbols(spark, sf_dir)
    whole = symbols.located_some(s, s, f)
    parts = [symbols.counted(whole, by).select(F.lit(by).alias("by"), "key", "n") for by in ("name", "lang", "tag", "file")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"WITH {px.SYMBOLS} SELECT count(DISTINCT name) AS groups, count(*) AS symbols FROM symbols")
def symbol_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: distinct groups and symbols."""
    return symbols.totals(px.symbols(spark, sf_dir), "name")


@query(f"""WITH RECURSIVE {_WINDOWS}, {px.SYMBOLS}, {px.FILES}, q AS (SELECT unnest([0, 1, 2]) AS query_id, unnest(['The', 'Of', 'Est']) AS query),
own AS (SELECT file_id * 1000 + grp AS chunk_id, win.file_id, path, start_line, end_line FROM win JOIN files USING (file_id))
SELECT DISTINCT query_id, chunk_id, own.path, CAST(own.start_line AS INTEGER) AS start_line FROM q JOIN symbols s ON s.name = q.query AND s.tag = 'def' JOIN own ON own.file_id = s.file_id AND s.start_line BETWEEN own.start_line AND own.end_line""")
def exact_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the definitions of a queried name."""
    q = spark.createDataFrame([(0, "The"), (1, "Of"), (2, "Est")], "query_id int, query string")
    w = ch.line_windows(px.files(spark, sf_dir))
    n = F.row_number().over(Window.partitionBy("file_id").orderBy("start_line")) - 1
    w = w.withColumn("chunk_id", F.col("file_id") * 1000 + n).withColumn("symbol_id", F.lit(None).cast("bigint"))
    return symbols.exact(q, px.symbols(spark, sf_dir), w)


@query(f"WITH {px.SYMBOLS} SELECT 'files' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'symbols', count(*) FROM symbols UNION ALL SELECT 'chunks', count(*) FROM documents")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: counts of files, symbols, chunks."""
    return symbols.status(px.files(spark, sf_dir), px.symbols(spark, sf_dir), px.chunks(spark, sf_dir))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 5")
def languages_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: the five most frequent languages."""
    return symbols.top_languages(px.table(spark, sf_dir, "documents"))


@query(f"WITH {_CLASSES} SELECT content_type, count(*) AS n FROM typed GROUP BY content_type")
def content_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: files by category."""
    f = classify.with_language(px.files(spark, sf_dir).select("file_id", "path"))
    f = f.select(classify.content_type(F.col("lang"), F.col("path")).alias("content_type"), F.col("file_id").alias("position"))
    return symbols.by_content(f)


# --- refresh ---------------------------------------------------------------------------------

_SNAPSHOTS = """w AS (SELECT 'f' || doc_id AS path, doc_id * 10 - CASE WHEN doc_id % 7 = 0 THEN 5 ELSE 0 END AS mtime_ns, n_chars + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 5 <> 0),
k AS (SELECT 'f' || doc_id AS path, doc_id * 10 AS mtime_ns, n_chars AS size FROM documents WHERE doc_id % 3 <> 0)"""
_STATES = """st AS (SELECT coalesce(w.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' WHEN w.mtime_ns IS DISTINCT FROM k.mtime_ns OR w.size IS DISTINCT FROM k.size THEN 'changed' ELSE 'same' END AS state
FROM w FULL JOIN k ON w.path = k.path)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = px.table(spark, sf_dir, "documents").withColumn("path", F.concat(F.lit("f"), "doc_id"))
    i = F.col("doc_id")
    walked = d.where(i % 5 != 0).select("path", (i * 10 - F.when(i % 7 == 0, 5).otherwise(0)).alias("mtime_ns"), (F.col("n_chars") + F.when(i % 11 == 0, 1).otherwise(0)).alias("size"))
    return walked, d.where(i % 3 != 0).select("path", (i * 10).alias("mtime_ns"), F.col("n_chars").alias("size"))


@query(f"WITH {_SNAPSHOTS}, {_STATES} SELECT * FROM st")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, deleted, changed and unchanged files."""
    return refresh.diff(*_snapshots(spark, sf_dir))


@query(f"WITH {_SNAPSHOTS}, {_STATES} SELECT count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'deleted') AS deleted FROM st")
def refresh_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts a refresh reports."""
    return refresh.report(refresh.diff(*_snapshots(spark, sf_dir)))


@query(f"WITH {_SNAPSHOTS}, {_STATES} SELECT path, mtime_ns, size FROM w UNION ALL SELECT k.path, k.mtime_ns, k.size FROM k WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.path = k.path) AND NOT EXISTS (SELECT 1 FROM st WHERE st.path = k.path AND st.state = 'deleted')")
def snapshot_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table after a refresh."""
    walked, known = _snapshots(spark, sf_dir)
    gone = refresh.diff(walked, known).where("state = 'deleted'")
    return refresh.upsert(refresh.without(known, gone), walked.withColumn("version", F.lit(1)))


@query("SELECT doc_id AS chunk_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that have no vector yet."""
    v = px.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return vectors.missing(px.chunks(spark, sf_dir).select("chunk_id"), v)


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber >= 3)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bag difference of two tables, both ways."""
    t = px.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return evaluate.bag_difference(t.where("l_linenumber <= 4"), t.where("l_linenumber >= 3"))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = CAST(floor(n * 0.95e0) AS BIGINT) THEN value END) AS p95 FROM o GROUP BY event_type""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: p50 and p95 by sorted position, of event values by type."""
    return evaluate.latency(px.table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3 (an extra): hourly events by type from a watermarked stream over the whole table."""
    from quarry.streaming.refresh import event_counts

    return event_counts(spark, f"{sf_dir}/events.parquet", _scratch(spark))


def _scratch(spark: SparkSession) -> str:
    """A folder under the shared checkpoint folder; in local mode (tests), a temporary one where none is set."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.mkdtemp(prefix='quarry-')}") + "/queries"
