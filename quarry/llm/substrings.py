"""Substring dedup with difference-cover anchors.

A set of residues D modulo V is a difference cover: for any two positions i and j some shift
d < V puts both i + d and j + d on residues of D.  So two equal windows of W words hold an equal run
of W - V + 1 words that starts, in both, at a position whose residue is in D.  Only such runs, the
anchors, are hashed for the search; a window is compared as a whole only if it holds an anchor that
occurs more than once in the corpus.

A text that an earlier row has in full loses all of its windows and is the first owner of none, so it
neither asks for anchors nor for windows.

Texts go into batches of a bounded size once.  What a batch asks is a table of hashes, a row for each
distinct one, which Spark groups by hash; the rows that are answered go back to their batches.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.arrowtext import SPACE, split_words, text_chunks, window_hashes, word_hashes
from quarry.llm.batches import BATCH_BYTES, batched

WINDOW = 20
#: A perfect difference cover, every difference modulo 13 once.
PERIOD, COVER = 13, (0, 1, 3, 9)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_LAST = np.int64(np.iinfo(np.int64).max)


def _same(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


class _Batch:
    """The words of one batch in the order of (doc_id, tie), and its anchors; `told` names the texts that an earlier batch row has."""

    def __init__(self, t: pa.Table, window: int, told: pa.Table) -> None:
        self.table = t = t.sort_by([("doc_id", "ascending"), ("_tie", "ascending")])
        self.window = window
        one, two, self.raw, bounds = [], [], [], [np.zeros(1, np.int64)]
        for _, raw, off in text_chunks(t["text"]):
            starts, ends, edge = split_words(raw, off, SPACE)
            one.append(word_hashes(raw, starts, ends, 0))
            two.append(word_hashes(raw, starts, ends, 1))
            bounds.append(edge[1:] + bounds[-1][-1])
            self.raw += [raw[a:b].tobytes() for a, b in zip(off, off[1:])]
        self.bounds = np.concatenate(bounds)
        self.one = np.concatenate([*one, np.zeros(0, np.uint64)])
        self.two = np.concatenate([*two, np.zeros(0, np.uint64)])
        n = len(self.one)
        lengths = np.diff(self.bounds)
        self.pos = np.arange(n) - np.repeat(self.bounds[:-1], lengths)
        self.left = np.repeat(lengths, lengths) - self.pos  # words from here to the end of the document
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        earlier = set(_told(told, 0, "same").to_pylist())
        copy = np.zeros(len(lengths), bool)
        for r, data in enumerate(self.raw):
            same = _same(data)
            copy[r] = same in earlier
            earlier.add(same)
        self.copy = np.repeat(copy & (lengths >= window), lengths)
        # Anchors only of documents that have a window at all.
        size = window - PERIOD + 1
        at = np.flatnonzero(_IN_COVER[self.pos % PERIOD] & (self.left >= size) & (self.pos + self.left >= window) & ~self.copy)
        self.anchor_at = at
        hashes = window_hashes(self.one, size)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
        self.anchors, self.anchor_of, self.count = np.unique(hashes, return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray) -> None:
        """Windows that hold a repeated anchor: first positions, distinct hashes, their first owners."""
        again = np.isin(self.anchors, repeated)
        mark = np.zeros(len(self.one) + PERIOD + 1, np.int64)
        mark[self.anchor_at[again[self.anchor_of]] + 1] = 1
        have = np.cumsum(mark)
        i = np.flatnonzero((self.left >= self.window) & ~self.copy)
        self.at = i = i[have[i + PERIOD] > have[i]]
        one = window_hashes(self.one, self.window)[i] if len(i) else np.zeros(0, np.uint64)
        two = window_hashes(self.two, self.window, 1)[i] if len(i) else np.zeros(0, np.uint64)
        order = np.lexsort((i, two, one))
        one, two = one[order], two[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(one) else np.zeros(0, bool)
        self.first = i[order[new]]  # the earliest position of each distinct window
        self.w1, self.w2 = one[new].view(np.int64), two[new].view(np.int64)
        self.window_of = np.empty(len(i), np.int64)
        self.window_of[order] = np.cumsum(new) - 1

    def removed(self, later: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Which words a window covers that starts earlier too; `later` are windows that an earlier batch row has."""
        gone = np.zeros(len(self.w1), bool)
        mine = np.rec.fromarrays([self.w1, self.w2])
        if len(later[0]) and len(mine):
            gone[np.isin(mine, np.rec.fromarrays(list(later)))] = True
        again = self.at[gone[self.window_of] | (self.first[self.window_of] != self.at)]
        step = np.zeros(len(self.one) + 1, np.int64)
        step[again] += 1
        step[again + self.window] -= 1
        return (np.cumsum(step)[:-1] > 0) | self.copy


def _told(t: pa.Table, phase: int, column: str) -> pa.ChunkedArray:
    return t.filter(pc.equal(t["phase"], phase))[column]


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Every input row with n_words, n_removed, the removed word ranges and the text that stays.

    Words are runs without `[\\x20\\x09-\\x0D]`, unchanged.  A word is removed if some window of
    `window` words covers it whose word sequence also starts earlier: in a row of a smaller doc_id,
    or earlier in the same row; rows of one doc_id go by a hash of their text, equal rows by their
    place in the input; null ids come last.  Windows are judged on the input.  `kept` holds the other
    words joined by one space.  Null and empty texts, and those shorter than a window, lose nothing;
    an empty table gives none.  Input columns of the names added here, and of `_tie` and `_batch`,
    are replaced.  `digest` returns doc_id, n_words, n_removed and kept_sha256 only.
    """
    if window <= PERIOD:
        raise ValueError(f"a window has more than {PERIOD} words")
    added = ("n_words", "n_removed", "removed", "kept", "_batch", "_tie")
    columns = ["doc_id", "text"] if digest else [c for c in docs.columns if c not in added]
    docs = docs.select(*columns).withColumn("doc_id", F.col("doc_id").cast("bigint")).withColumn("text", F.col("text").cast("string"))
    tie = F.struct(F.xxhash64("text").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows, _, parts = batched(docs.withColumn("_tie", tie), batch_bytes)
    # Sixteen bytes, ordered as the two numbers without a sign.
    rows = rows.withColumn("_tie", F.unhex(F.concat(*[F.lpad(F.hex(F.col(f"_tie.{c}")), 16, "0") for c in ("text", "row")])))

    def ask_texts(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("_tie", "ascending")])
        same = [_same(raw[a:b].tobytes()) for _, raw, off in text_chunks(t["text"]) for a, b in zip(off, off[1:])]
        first: dict[bytes, int] = {}
        for r, x in enumerate(same):
            first.setdefault(x, r)
        row = pa.array(list(first.values()), pa.int64())
        return pa.table([pa.array(list(first), pa.binary()), t["doc_id"].fill_null(_LAST).take(row), t["doc_id"].is_null().take(row), t["_tie"].take(row), pa.array(np.full(len(row), key[0].as_py()))], names=["same", "doc_id", "none", "_tie", "_batch"])

    def ask_anchors(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(t, window, told)
        return pa.table([pa.array(b.anchors), pa.array(b.count.astype(np.int32)), pa.array(np.full(len(b.anchors), key[0].as_py()))], names=["a", "n", "_batch"])

    def ask_windows(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(t, window, told)
        b.candidates(_told(told, 1, "a").to_numpy())
        row = pa.array(b.row[b.first])
        return pa.table([pa.array(b.w1), pa.array(b.w2), b.table["doc_id"].fill_null(_LAST).take(row), b.table["doc_id"].is_null().take(row), b.table["_tie"].take(row), pa.array(np.full(len(row), key[0].as_py()))], names=["a", "b", "doc_id", "none", "_tie", "_batch"])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] if digest else [*columns, "n_words", "n_removed", "removed", "kept"]
    spans = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    if digest:
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    else:
        schema = T.StructType([*rows.select(*columns).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans), T.StructField("kept", T.StringType())])

    def cut(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(t, window, told)
        b.candidates(_told(told, 1, "a").to_numpy())
        gone = b.removed((_told(told, 2, "a").to_numpy(), _told(told, 2, "b").to_numpy()))
        lost = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), b.bounds[:-1]) * (np.diff(b.bounds) > 0) if len(b.bounds) > 1 else np.zeros(0, np.int64)
        kept, ranges = [], []
        for r, data in enumerate(b.raw):
            words = data.split()
            if lost[r]:
                g = gone[b.bounds[r] : b.bounds[r + 1]]
                edge = np.diff(np.concatenate([[0], g.astype(np.int8), [0]]))
                ranges.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
                words = [w for w, x in zip(words, g.tolist()) if not x]
            else:
                ranges.append([])
            text = b" ".join(words)
            kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
        n = pa.array(np.diff(b.bounds), pa.int64())
        head = [b.table[c].combine_chunks() for c in (["doc_id"] if digest else columns)]
        tail = [pa.array(kept, pa.string())] if digest else [pa.array(ranges, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(kept, pa.string())]
        return pa.table([*head, n, pa.array(lost, pa.int64()), *tail], names=names)

    # A hash or text that a third of all documents hold is one row for each batch.  The first window over
    # anchors holds such a hash's rows together, and spills; the others keep a running number.
    by_hash = Window.partitionBy("a")
    no = {"a": F.lit(None).cast("bigint"), "b": F.lit(None).cast("bigint"), "same": F.lit(None).cast("binary")}
    tell = lambda df, phase, **has: df.select(*[(has[c] if c in has else no[c]).alias(c) for c in no], "_batch", F.lit(phase).alias("phase"))
    hear = lambda df: rows.groupBy("_batch").cogroup(df.repartition(parts, "_batch").groupBy("_batch"))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("none", "doc_id", "_tie"))
    owned = "doc_id bigint, none boolean, _tie binary, _batch bigint"
    texts = rows.groupBy("_batch").applyInArrow(ask_texts, f"same binary, {owned}")
    told = tell(texts.withColumn("nth", nth("same")).where("nth > 1"), 0, same=F.col("same"))
    anchors = hear(told).applyInArrow(ask_anchors, "a bigint, n int, _batch bigint")
    told = told.unionByName(tell(anchors.withColumn("n", F.sum("n").over(by_hash)).where("n > 1"), 1, a=F.col("a")))
    windows = hear(told).applyInArrow(ask_windows, f"a bigint, b bigint, {owned}")
    told = told.unionByName(tell(windows.withColumn("nth", nth("a", "b")).where("nth > 1"), 2, a=F.col("a"), b=F.col("b")))
    return hear(told).applyInArrow(cut, schema)


#: DuckDB SQL of `dedup(digest=True)`.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM rep),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (
  SELECT word.doc_id, count(gone.k) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY word.k) FILTER (gone.k IS NULL), '') AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.k = word.k GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
