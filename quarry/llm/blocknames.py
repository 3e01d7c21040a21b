"""Exact dedup by deterministic block naming.

A text, without its white space, is cut into blocks of a fixed size.  The distinct blocks are sorted
and each gets an integer, its name; then adjacent names are paired, the distinct pairs are sorted and
named, and so on until each text has one name.  At one level equal names mean equal blocks, so by
induction two texts that end at one level under one name are equal byte by byte: nothing is hashed
into an identity, and no two texts can collide.

A run of a task's rows is named by itself first.  Texts equal within it become one, its speaker, so a
text that a third of all rows hold is one row for each run when blocks meet.  Names of the whole
corpus are ranks within a bucket of sorted blocks (or pairs): bucket + BUCKETS * rank.  Each level has half
the names of the one before and holds only the texts that are not done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.arrowtext import SPACE, small_batches, text_chunks
from quarry.llm.batches import in_runs
from quarry.llm.tables import written

#: Bytes of a block: most texts are one or two.
BLOCK = 4096
#: Arrow bytes of a run of rows that is named by itself.
RUN_BYTES = 16 << 20
#: Buckets of blocks or pairs, as many for any input: a name depends on the corpus' texts alone.
BUCKETS = 1 << 24
#: What stands beside the last name of a text that has an odd number of them.
NONE = -1

ROWS = "run bigint, row int, doc_id bigint, n_chars bigint, text_sha256 string, local int, n_blocks int, blocks array<binary>"


def normalised(column: pa.ChunkedArray) -> Iterator[tuple[bytes, int]]:
    """(text without `[\\x20\\x09-\\x0D]`, code points of the text) of each row; null is empty."""
    for _, raw, off in text_chunks(column):
        stays = ~SPACE[raw]
        left = raw[stays].tobytes()
        kept = np.concatenate([[0], np.cumsum(stays)])[off]
        chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
        for a, b, n in zip(kept.tolist(), kept[1:].tolist(), np.diff(chars).tolist()):
            yield left[a:b], n


def blocks_of(text: bytes, block: int = BLOCK) -> list[bytes]:
    """The blocks of a text; the last may be shorter, and an empty text is one empty block."""
    return [text[i : i + block] for i in range(0, len(text), block)] or [b""]


def names_of(texts: list[list]) -> list[tuple[int, int]]:
    """(level, name) of each sequence of blocks; equal for equal sequences, and only for them."""
    out: list = [None] * len(texts)
    level, now = 0, dict(enumerate(texts))
    while now:
        name = {b: k for k, b in enumerate(sorted({b for t in now.values() for b in t}))}
        now = {i: [name[b] for b in t] for i, t in now.items()}
        for i in [i for i, t in now.items() if len(t) == 1]:
            out[i] = level, now.pop(i)[0]
        now = {i: [(t[k], t[k + 1] if k + 1 < len(t) else NONE) for k in range(0, len(t), 2)] for i, t in now.items()}
        level += 1
    return out


def _runs(docs: DataFrame, block: int, run_bytes: int) -> DataFrame:
    """ROWS of every input row; n_blocks and blocks only in the first row of those that are equal in a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, t in in_runs(batches, run_bytes):
            texts = [*normalised(t["text"])]
            cut = [blocks_of(x, block) for x, _ in texts]
            first: dict = {}
            local = [first.setdefault(n, i) for i, n in enumerate(names_of(cut))]
            speaks = [i == k for i, k in enumerate(local)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(texts), number)),
                    pa.array(range(len(texts)), pa.int32()),
                    t["doc_id"].combine_chunks(),
                    pa.array([n for _, n in texts], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x, _ in texts]),
                    pa.array(local, pa.int32()),
                    pa.array([len(b) if s else None for b, s in zip(cut, speaks)], pa.int32()),
                    pa.array([b if s else None for b, s in zip(cut, speaks)], pa.list_(pa.binary())),
                ],
                names=["run", "row", "doc_id", "n_chars", "text_sha256", "local", "n_blocks", "blocks"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def _named(items: DataFrame, *by: str) -> DataFrame:
    """`items` with `name`: equal for rows that are equal in `by`, and only for them."""
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    ranked = items.withColumn("bucket", bucket).withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy(*by)))
    return ranked.withColumn("name", F.col("bucket") + (F.col("rank") - 1) * F.lit(BUCKETS)).drop("bucket", "rank", *by)


def _identities(rows: DataFrame) -> DataFrame:
    """run, local, level, name of every speaker."""
    speakers = rows.where("n_blocks is not null")
    most = speakers.agg(F.coalesce(F.max("n_blocks"), F.lit(1))).first()[0]
    items = speakers.select("run", "local", "n_blocks", F.posexplode("blocks").alias("pos", "block"))
    now = written(_named(items, "block"))
    out = now.where("n_blocks = 1").select("run", "local", F.lit(0).alias("level"), "name")
    level = 0
    while most > 1:  # as often as the longest text's blocks can be halved
        level, most = level + 1, -(-most // 2)
        own = now.where("n_blocks > 1").groupBy("run", "local", "n_blocks", F.expr("pos div 2").cast("int").alias("half"))
        even = F.col("pos") % 2 == 0
        pairs = own.agg(F.max(F.when(even, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("right"))
        pairs = pairs.select("run", "local", F.expr("(n_blocks + 1) div 2").cast("int").alias("n_blocks"), F.col("half").alias("pos"), "left", "right")
        now = written(_named(pairs, "left", "right"))
        out = out.unionByName(now.where("n_blocks = 1").select("run", "local", F.lit(level).alias("level"), "name"))
    return out


def dedup(docs: DataFrame, block: int = BLOCK, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chars, level, name for every input row.

    Texts are equal when they are the same after white space `[\\x20\\x09-\\x0D]` goes; a null text
    is an empty one, and so equals one of white space only.  (level, name) is a text's identity.  Of
    equal rows, the one of most code points in the unchanged text stays, then of the smallest
    doc_id, a null id last; of rows that repeat an id too, one (any) stays.  keep_id is null where
    the row that stays has a null id.  Columns other than doc_id and
    text are left out.  An empty table gives no rows.
    """
    if block < 1:
        raise ValueError("a block holds a byte at least")
    rows = written(_runs(docs, block, run_bytes))  # the run numbers are fixed from here on
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "run", "row"))
    locally = rows.groupBy("run", "local").agg(F.count("*").alias("n"), best.alias("best"))
    held = written(_identities(rows).join(locally, ["run", "local"]))
    groups = held.groupBy("level", "name").agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
    told = held.select("run", "local", "level", "name").join(groups, ["level", "name"])
    out = rows.select("run", "row", "doc_id", "n_chars", "text_sha256", "local").join(told, ["run", "local"])
    kept = (F.col("best.run") == F.col("run")) & (F.col("best.row") == F.col("row"))
    return out.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "n_chars", "level", "name")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of `dedup`."""
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: DuckDB SQL of `digest`.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS t, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""
