"""Documents in batches of a bounded size, and questions that batches ask of all batches.

`asked` is the round trip that several operators need.  Each batch sends the distinct hashes it
holds, one binary cell for each target bucket; a bucket sees every batch's copy of a hash, works out
one answer per hash and batch, and sends the answers back in the order in which they were asked.
Neither a batch nor a bucket holds more than a bounded share of the corpus, and a hash that a third
of all documents hold is one entry per batch, however often the batch holds it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import small_batches
from quarry.llm.tables import text_bytes

#: UTF-8 bytes of text in a batch, about; one longer document is a batch of its own size.
BATCH_BYTES = 2 << 20
#: Shuffle partitions at most; beyond it a partition holds several batches, one after the other.
MOST_PARTITIONS = 20_000

ASK = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("cell", pa.binary())])
ASK_DDL = "bucket bigint, batch bigint, cell binary"


def batched(docs: DataFrame, batch_bytes: int = BATCH_BYTES, by: Column | None = None, size: int | None = None) -> tuple[DataFrame, int, int]:
    """(rows with a `_batch` column laid out by it, batches, partitions).

    A row's batch is drawn by the hash `by`, or else from its place in the input: then rows of one
    id, null ids and equal texts are spread, and a task that reads a table again draws the same.
    `size` is that of all texts if it is known.
    """
    small_batches(docs.sparkSession)
    size = text_bytes(docs)[1] if size is None else size
    n = max(1, -(-size // batch_bytes))
    parts = min(n, MOST_PARTITIONS)
    batch = F.pmod(F.xxhash64(F.monotonically_increasing_id()) if by is None else by, F.lit(n)).cast("bigint")
    return docs.withColumn("_batch", batch).repartition(parts, "_batch"), n, parts


def by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ascending distinct hashes: (bucket ids, first, last) of the runs that go to one bucket each.

    Buckets cut the hash range evenly, so a run is contiguous.
    """
    width = np.uint64(((1 << 64) - 1) // buckets + (buckets > 1))
    at = (hashes // width).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    return at[first], first, np.concatenate([first[1:], [len(at)]]).astype(np.int64)


def asks(batch: int, runs: tuple, cells: Callable[[int, int], bytes]) -> pa.Table:
    ids, first, last = runs
    return pa.table([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), batch), pa.int64()), pa.array([cells(a, b) for a, b in zip(first, last)], pa.binary())], schema=ASK)


def answered(asked: DataFrame, parts: int, answer: Callable[[list[bytes], list[int]], list[bytes]]) -> DataFrame:
    """Per bucket: `answer(cells, batches)` gives a cell for each cell; laid out by bucket, not batch."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        batches = t["batch"].to_pylist()
        return pa.table([t["bucket"].combine_chunks(), t["batch"].combine_chunks(), pa.array(answer(t["cell"].to_pylist(), batches), pa.binary())], schema=ASK)

    return asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, ASK_DDL)


def in_runs(batches: Iterator[pa.RecordBatch], batch_bytes: int = BATCH_BYTES) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of runs of a task's rows, about `batch_bytes` of Arrow data each.

    Numbers are the task's partition and a count, so a task that is run again gives the same; they
    name the runs for good only once what was made of them is written, since a later query may
    divide the input otherwise.
    """
    number, have, size = TaskContext.get().partitionId() << 33, [], 0
    for b in batches:
        have.append(b)
        size += b.nbytes
        if size >= batch_bytes:
            yield number, pa.Table.from_batches(have)
            number, have, size = number + 1, [], 0
    if have:
        yield number, pa.Table.from_batches(have)
