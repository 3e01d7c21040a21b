"""Unit vectors, exact nearest neighbours and a deterministic encoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import folded, matches
from quarry.operators.lexical import WORD, top

#: Bytes of the vectors of one block; scores that are worked out at once.
BLOCK_BYTES, CELL = 32 << 20, 1 << 22


def unit(v: Column) -> Column:
    """The vector over its Euclidean norm, in doubles; a zero vector stays zero."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, cosine) of the k largest of each query, ties by id; rows of `v` in ascending id."""
    rows, found, scores = [], [], []
    step = max(1, CELL // max(1, len(v)))
    for a in range(0, len(q), step):
        score = np.round(q[a : a + step] @ v.T, digits)
        if k < len(v):
            least = np.partition(score, len(v) - k, axis=1)[:, len(v) - k]
            row, at = np.nonzero(score >= least[:, None])
        else:
            row, at = (x.ravel() for x in np.indices(score.shape))
        order = np.lexsort((at, -score[row, at], row))
        row, at = row[order], at[order]
        first = np.searchsorted(row, np.arange(len(score)))
        some = np.arange(len(row)) - first[row] < k
        rows.append(row[some] + a)
        found.append(ids[at[some]])
        scores.append(score[row[some], at[some]])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _unit(vectors: pa.ChunkedArray) -> np.ndarray:
    m = np.stack(vectors.combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 30, digits: int = 6, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k largest cosines, ties by id.

    Queries and stored vectors are cut into blocks of `block_bytes`, by the hash of their id.  Every
    block of the one meets every block of the other in a cell, which multiplies them and passes on its
    own k best of each query; the best of those are the result.  A vector is sent once for each block
    of queries, a query once for each block of vectors, and nothing goes through the driver but two
    counts and a width.  Null vectors do not count; all vectors are of one width.
    """
    own = lambda df, key: df.select(F.col(key).cast("bigint").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")).where("vec is not null")
    q, v = own(queries, "query_id"), own(vectors, "chunk_id")
    # Two counts; a side whose ids and widths do not change while they are read.
    many = lambda df: df.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("width")).first()
    of_q, of_v = many(q), many(v)
    rows = max(1, block_bytes // (8 * max(1, of_q.width, of_v.width)))
    nq, nv = max(1, -(-of_q.n // rows)), max(1, -(-of_v.n // rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = q.select("id", "vec", block(nq).alias("qb"), every(nv).alias("vb"))
    v = v.select("id", "vec", block(nv).alias("vb_"), every(nq).alias("qb_"))

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["query_id", "chunk_id", "score"])
        two = two.sort_by("id")
        row, found, score = _best(_unit(one["vec"]), _unit(two["vec"]), two["id"].to_numpy(), k, digits)
        return pa.table([one["id"].combine_chunks().take(pa.array(row)), pa.array(found), pa.array(score)], names=["query_id", "chunk_id", "score"])

    met = q.groupBy("qb", "vb").cogroup(v.groupBy("qb_", "vb_")).applyInArrow(cell, "query_id bigint, chunk_id bigint, score double")
    return top(met, k)


def hashed(text: Column, dims: int = 64) -> Column:
    """A deterministic encoder: signed counts of folded words in `dims` hashed places, to unit length.

    It stands where no embedding model is at hand.
    """
    words = matches(folded(F.coalesce(text, F.lit(""))), r"[\p{L}\p{N}]+")
    spots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(2 * dims)))
    counts = F.map_from_entries(F.transform(F.array_distinct(spots), lambda s: F.struct(s, F.size(F.filter(spots, lambda x: x == s)))))
    at = lambda s: F.coalesce(F.element_at(counts, s), F.lit(0))
    return unit(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), lambda i: (at(i) - at(i + dims)).cast("double")))


#: Tokens of a text that are looked up, and rows of a learned table; texts and rounds that one is learned from.
MOST_TOKENS, VOCABULARY, SAMPLE, ROUNDS = 512, 20_000, 20_000, 3
#: Texts of one block, and rows of the table that are added up at once.
TEXTS, GATHERED = 4096, 1 << 16


def pooled(items: DataFrame, text: str, table: DataFrame, dims: int, digits: int | None = None, texts: int = TEXTS) -> DataFrame:
    """`vec` beside the items' columns: the mean of the rows of `table` (token, row) that a text's first
    MOST_TOKENS known words have, to unit length; zeros for a text without any.

    Texts are cut into blocks of `texts`, by their place in the input.  A block's distinct words are joined
    with the table, and a cell looks its texts' words up in the rows found: a row is sent once for each
    block that has its word, not for each time that it occurs.  All rows of the table have `dims` numbers.
    Rows that repeat are told apart; a column `vec` is replaced.
    """
    items = items.drop("vec").withColumn("_row", F.monotonically_increasing_id())
    n = max(1, -(-items.count() // texts))
    words = matches(folded(F.coalesce(F.col(text), F.lit(""))), WORD)
    each = items.select("_row", F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int").alias("cell"), words.alias("words"))
    known = each.select("cell", F.explode("words").alias("token")).distinct().join(table.select("token", "row"), "token").select(F.col("cell").alias("cell_"), "token", "row")

    def cell(one: pa.Table, two: pa.Table) -> pa.Table:
        many = pc.list_value_length(one["words"].combine_chunks()).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(many)), many)
        code = pc.index_in(one["words"].combine_chunks().flatten(), two["token"].combine_chunks()).fill_null(-1).to_numpy()
        row, code = row[code >= 0], code[code >= 0]
        some = np.arange(len(row)) - np.searchsorted(row, row) < MOST_TOKENS
        row, code = row[some], code[some]
        rows = two["row"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dims)
        m = np.zeros((len(many), dims))
        for a in range(0, len(row), GATHERED):
            own, first = np.unique(row[a : a + GATHERED], return_index=True)
            m[own] += np.add.reduceat(rows[code[a : a + GATHERED]], first, axis=0)
        held = np.bincount(row, minlength=len(many))
        m, ids = m[held > 0] / held[held > 0, None], one["_row"].to_numpy()[held > 0]
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * dims, pa.int32()), pa.array(m.ravel()))
        return pa.table([pa.array(ids, pa.int64()), vec], names=["_row", "vec"])

    made = each.groupBy("cell").cogroup(known.groupBy("cell_")).applyInArrow(cell, "_row bigint, vec array<double>")
    zero = F.array_repeat(F.lit(0.0), dims)
    out = items.join(made, "_row", "left").withColumn("vec", F.coalesce("vec", zero)).drop("_row")
    return out if digits is None else out.withColumn("vec", F.transform("vec", lambda x: F.round(x, digits)))


def learned(chunks: DataFrame, text: str = "text", dims: int = 64, vocabulary: int = VOCABULARY, sample: int = SAMPLE) -> DataFrame:
    """(token, row) learned from a corpus: words that occur in like texts get like rows.

    Document frequencies are the whole corpus's, and the `vocabulary` words of the most texts get rows
    (ties by word).  The rows are the leading factors of the weighted table of words and texts, worked
    out by subspace iteration on the driver from `sample` texts at most, those of the smallest hashes:
    both are bounds of what the driver holds.  The same corpus gives the same rows.
    """
    spark = chunks.sparkSession
    words = F.array_distinct(matches(folded(F.coalesce(F.col(text), F.lit(""))), r"[\p{L}\p{N}]+"))
    rows = chunks.select(F.xxhash64(text).alias("h"), words.alias("words"))
    n = rows.count()
    df = rows.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    kept = {r.token: (k, r.df) for k, r in enumerate(df.orderBy(F.desc("df"), "token").limit(vocabulary).collect())}
    texts = [r.words for r in rows.distinct().orderBy("h").limit(sample).collect()]
    at = [np.array([kept[w][0] for w in t if w in kept], np.int64) for t in texts]
    weight = np.log((n + 1) / np.array([d for _, d in kept.values()] or [1.0]))
    owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
    term = np.concatenate([*at, np.zeros(0, np.int64)])
    value = weight[term] / np.sqrt(np.maximum(np.bincount(owner, weights=weight[term] ** 2, minlength=len(at)), 1e-12))[owner] if len(term) else np.zeros(0)
    basis = np.random.default_rng(7).standard_normal((len(kept), dims))

    def times(index: np.ndarray, into: np.ndarray, size: int, right: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(into, weights=value * right[index, j], minlength=size) for j in range(right.shape[1])], axis=1)

    for _ in range(ROUNDS if len(term) else 0):
        basis = times(owner, term, len(kept), np.linalg.qr(times(term, owner, len(at), basis))[0]) if len(at) >= dims else times(owner, term, len(kept), times(term, owner, len(at), basis))
    size = np.linalg.norm(basis, axis=1, keepdims=True)
    rows = (basis / np.maximum(size, 1e-12) * np.minimum(weight, weight.max() if len(kept) else 1.0)[: len(kept), None]).round(6)
    return spark.createDataFrame([(w, row.tolist()) for w, row in zip(kept, rows)], "token string, row array<double>")


def missing(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """Items without a vector, in the order in which they are encoded."""
    return items.join(vectors.select("chunk_id"), "chunk_id", "left_anti").orderBy("chunk_id")


def drift(stored: list[list[float]], now: list[list[float]]) -> str:
    """`stale` under 0.99, `warn` under 0.9999, else `same`: the least cosine of fixed texts' vectors."""
    a, b = np.array(stored, float), np.array(now, float)
    if a.shape != b.shape:
        return "stale"
    cos = (a * b).sum(1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-300)
    return "stale" if cos.min() < 0.99 else "warn" if cos.min() < 0.9999 else "same"
