"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words of a text and one end.  A context is the run of up to `order` symbols before
a symbol; before a text stand ends.  It is a node of the tree if the training texts have it `LEAST`
times and its next-symbol distribution diverges from that of the longest shorter context that is a
node; the empty context always is.  A node's distribution is discounted and smoothed towards that
one's, the empty context's is the add-one unigram distribution with one symbol for all unknown words.
A symbol is scored at the longest suffix of what came before that is a node.

The tree is never in one place.  It grows with the corpus: batches of texts send the contexts and
symbols that they hold, with their training counts, to the bucket of the context's hash, where the
counts meet, the test is made, and the counts of the nodes go back.  Length by length, only contexts
that extend one seen often enough are sent.  With a word's count comes its number, words of high
counts first, and all later cells name words by their numbers: these are small, so cells, which
travel compressed, hold few bytes for each, and no two words share one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import LOWER, SPACE, mix, small_batches, split_words, text_chunks, word_hashes
from quarry.llm.batches import ASK, answered, asks, batched, by_bucket
from quarry.llm.langid import held_out
from quarry.llm.tables import text_bytes

#: Symbols of the longest context.
ORDER = 2
#: Training occurrences that a context has at least.
LEAST = 2
#: Bytes of a word's number.
APART = 5
#: A node's likelihood gain over its parent, in nats for each next symbol it has been seen with.
GAIN = 1.0
#: What each symbol seen after a node gives up, shared out by the parent's distribution.
DISCOUNT = 0.75
#: A parent's log probability is sent in one byte, in such parts of a nat, for the test alone.
PARTS = 8
#: Batches whose hashes one bucket takes, on average.
BATCHES_PER_BUCKET = 2
#: UTF-8 bytes of text in a batch, about.
BATCH_BYTES = 6 << 20
_END = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
_HALF = np.uint64(32)
_ZSTD = pa.Codec("zstd", compression_level=1)
_JUDGED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _planes(x: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of whole numbers, byte by byte: planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _whole(data: bytes, at: int, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
    return out.view("<u8").ravel()


def _packed(data: bytes) -> bytes:
    """The bytes compressed, after their number."""
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return _ZSTD.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose texts are compressed one by one; a null text stays null."""
    for b in batches:
        at = b.schema.get_field_index("text")
        texts = b["text"].cast(pa.large_binary())
        yield b.set_column(at, "text", pa.array([None if x is None else _packed(x) for x in texts.to_pylist()], pa.binary()))


def _texts(packed: pa.ChunkedArray) -> pa.LargeStringArray:
    """Texts that `_packed_texts` compressed; a null text is empty."""
    texts = [b"" if x is None else _unpacked(x) for x in packed.to_pylist()]
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


def _longer(context: np.ndarray, symbol: np.ndarray, length: int) -> np.ndarray:
    """Names of the contexts of `length` that add a symbol's number to a shorter one's name.

    A context of one is its word's number; of two, both numbers side by side if they fit, which is exact;
    every other a hash.
    """
    with np.errstate(over="ignore"):
        hashed = mix(context * _ODD + symbol)
    if length > 2:
        return hashed
    return np.where((context | symbol) >> _HALF == 0, context << _HALF | symbol, hashed)


class _Batch:
    """The symbols of a batch's texts, and how often its training rows have each."""

    def __init__(self, t: pa.Table, told: pa.Table | None = None) -> None:
        self.table = t
        hashes, bounds = [], [np.zeros(1, np.int64)]
        for _, raw, off in text_chunks(_texts(t["text"])):
            raw = LOWER[raw]
            starts, ends, edge = split_words(raw, off, SPACE)
            hashes.append(np.insert(word_hashes(raw, starts, ends), edge[1:], _END))
            bounds.append(edge[1:] + np.arange(1, len(edge)) + bounds[-1][-1])
        self.bounds = np.concatenate(bounds)
        self.symbol = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.words, self.word_of = np.unique(self.symbol, return_inverse=True)
        n = np.diff(self.bounds)
        self.train = np.repeat(~t["held_out"].to_numpy(zero_copy_only=False), n)
        self.count = np.bincount(self.word_of[self.train], minlength=len(self.words))
        self.start = np.zeros(len(self.symbol), bool)
        self.start[self.bounds[:-1]] = True
        self.n = self.v = 0
        self._told: dict[tuple[int, int], bytes] = {}
        for p, k, c, n, v in zip(*(told[x].to_pylist() for x in ("phase", "bucket", "cell", "n", "v"))) if told is not None else ():
            if p < 0:
                self.n, self.v = n, v
            else:
                self._told[p, k] = _unpacked(c)

    def word_runs(self, buckets: int) -> tuple:
        return by_bucket(self.words, buckets)

    def word_cell(self, a: int, b: int) -> bytes:
        return _planes(self.words[a:b], 8) + _planes(self.count[a:b], 4)

    def climb(self, buckets: int, length: int) -> None:
        """Everything known of contexts up to `length`: probabilities, and the contexts that are one longer."""
        known, number = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.uint64)
        for k, a, b in zip(*self.word_runs(buckets)):
            known[a:b] = _whole(self._told[0, k], 0, b - a, 6)
            number[a:b] = _whole(self._told[0, k], 6 * (b - a), b - a, APART) * np.uint64(buckets) + np.uint64(k)
        if len(number) and int(number.max()) >= 1 << 8 * APART:
            raise ValueError("the corpus has more words than APART bytes can number")
        self.known, self.number = known[self.word_of], number[self.word_of]
        self.p = (self.known + 1.0) / (self.n + self.v + 1.0)
        end = np.searchsorted(self.words, [_END])[: len(self.words)]
        ends, end = int(known[end].sum()), number[end]
        self.context = np.where(self.start, end, np.roll(self.number, 1)) if len(end) else self.number
        begin, seen = end, self.known
        for k in range(1, length + 1):
            often = np.where(self.start, ends, np.roll(seen, 1)) >= LEAST
            for j, a, b in zip(*self._asked(often, buckets)):
                self._hear(self._told[k, j], a, b)
            at = np.flatnonzero(often)
            total = np.zeros(len(self.symbol), np.int64)
            total[at[self.pair_at]] = self.total[self.pair_of]
            n, types = self.node_n[self.context_of], self.node_types[self.context_of]
            node = n > 0
            own = np.maximum(total[at] - DISCOUNT, 0.0)
            self.p[at[node]] = (own[node] + DISCOUNT * types[node] * self.p[at[node]]) / n[node]
            seen = total
            begin = _longer(begin, end, k + 1)
            self.context = np.where(self.start, begin, _longer(np.roll(self.context, 1), np.roll(self.number, 1), k + 1)) if len(end) else self.number
        self.often = np.where(self.start, ends, np.roll(seen, 1)) >= LEAST

    def _asked(self, often: np.ndarray, buckets: int) -> tuple:
        """The distinct contexts of the symbols marked, by bucket and name, and their distinct pairs with known symbols."""
        at = np.flatnonzero(often)
        names, self.context_of = np.unique(self.context[at], return_inverse=True)
        bucket = (mix(names) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.contexts, self.context_of, bucket = names[order], place[self.context_of], bucket[order]
        self.pair_at = np.flatnonzero(self.known[at] > 0)
        key = self.context_of[self.pair_at] * max(1, len(self.words)) + self.word_of[at[self.pair_at]]
        key, first, self.pair_of = np.unique(key, return_index=True, return_inverse=True)
        at = at[self.pair_at]
        self.pair_count = np.bincount(self.pair_of[self.train[at]], minlength=len(key))
        at = at[first]
        self.low = self.number[at]
        self.code = np.minimum(np.rint(-PARTS * np.log(self.p[at])), 255).astype(np.int64)
        self.edge = np.searchsorted(key // max(1, len(self.words)), np.arange(len(self.contexts) + 1))
        self.total = np.zeros(len(key), np.int64)
        self.node_n, self.node_types = np.zeros(len(self.contexts), np.int64), np.zeros(len(self.contexts), np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        return bucket[first], first, np.append(first[1:], len(bucket)) if len(first) else first

    def pair_runs(self, buckets: int) -> tuple:
        return self._asked(self.often, buckets)

    def pair_cell(self, a: int, b: int) -> bytes:
        x, y = self.edge[a], self.edge[b]
        head = np.array([b - a, y - x], np.int64).tobytes() + _planes(self.contexts[a:b], 8) + _planes(np.diff(self.edge[a : b + 1]), 4)
        return head + _planes(self.low[x:y], APART) + _planes(self.code[x:y], 1) + _planes(self.pair_count[x:y], 4)

    def _hear(self, cell: bytes, a: int, b: int) -> None:
        x, y, n = self.edge[a], self.edge[b], b - a
        self.node_n[a:b], self.node_types[a:b] = _whole(cell, 0, n, 6), _whole(cell, 6 * n, n, 6)
        self.total[x:y] = _whole(cell, 12 * n, y - x, 6)


def _counts(cells: list[bytes], _: list[int]) -> list[bytes]:
    """Per cell: every word's training count, and its place among the bucket's words by count and hash."""
    sizes = [len(c) // 12 for c in cells]
    words = np.concatenate([_whole(c, 0, n, 8) for c, n in zip(cells, sizes)])
    count = np.concatenate([_whole(c, 8 * n, n, 4) for c, n in zip(cells, sizes)])
    key, at = np.unique(words, return_inverse=True)
    total = np.bincount(at, weights=count, minlength=len(key)).astype(np.int64)
    place = np.empty(len(key), np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(key))
    cut = np.cumsum(sizes)[:-1]
    return [_planes(x, 6) + _planes(y, APART) for x, y in zip(np.split(total[at], cut), np.split(place[at], cut))]


def _totals(t: pa.Table) -> pa.Table:
    """Training symbols of a bucket, and distinct ones."""
    cells = [_unpacked(c) for c in t["cell"].to_pylist()]
    sizes = [len(c) // 12 for c in cells]
    words = np.concatenate([_whole(c, 0, n, 8) for c, n in zip(cells, sizes)])
    count = np.concatenate([_whole(c, 8 * n, n, 4) for c, n in zip(cells, sizes)])
    return pa.table({"n": pa.array([int(count.sum())], pa.int64()), "v": pa.array([len(np.unique(words[count > 0]))], pa.int64())})


def _nodes(cells: list[bytes], _: list[int]) -> list[bytes]:
    """Per cell: count and next symbols of every context that is a node, 0 for others; every pair's count."""
    contexts, lengths, pairs, codes, counts, sizes = [], [], [], [], [], []
    for c in cells:
        n, m = np.frombuffer(c, np.int64, 2).tolist()
        at = 16 + 12 * n
        contexts.append(_whole(c, 16, n, 8))
        lengths.append(_whole(c, 16 + 8 * n, n, 4).astype(np.int64))
        pairs.append(_whole(c, at, m, APART))
        codes.append(_whole(c, at + APART * m, m, 1))
        counts.append(_whole(c, at + (APART + 1) * m, m, 4))
        sizes.append((n, m))
    key, context_of = np.unique(np.concatenate(contexts), return_inverse=True)
    if len(key) >= 1 << (64 - 8 * APART):
        raise ValueError("a bucket holds too many contexts: take smaller batches or more buckets")
    pair = np.repeat(context_of, np.concatenate(lengths)).astype(np.uint64) << np.uint64(8 * APART) | np.concatenate(pairs)
    pair, first, pair_of = np.unique(pair, return_index=True, return_inverse=True)
    total = np.bincount(pair_of, weights=np.concatenate(counts), minlength=len(pair))
    of, code = (pair >> np.uint64(8 * APART)).astype(np.int64), np.concatenate(codes)[first].astype(np.float64)  # the same in every batch
    some = total > 0
    n = np.bincount(of, weights=total, minlength=len(key))
    types = np.bincount(of[some], minlength=len(key))
    gain = np.bincount(of[some], weights=total[some] * (np.log(total[some] / n[of[some]]) + code[some] / PARTS), minlength=len(key))
    node = (n >= LEAST) & (gain >= GAIN * types)
    n, types, total = np.where(node, n, 0).astype(np.int64), np.where(node, types, 0), total.astype(np.int64)
    out, a, b = [], 0, 0
    for k, m in sizes:
        own = context_of[a : a + k]
        out.append(_planes(n[own], 6) + _planes(types[own], 6) + _planes(total[pair_of[b : b + m]], 6))
        a, b = a + k, b + m
    return out


def _answer(answer: Callable[[list[bytes], list[int]], list[bytes]]) -> Callable[[list[bytes], list[int]], list[bytes]]:
    """`answer` of compressed cells in compressed cells."""
    return lambda cells, batches: [_packed(c) for c in answer([_unpacked(c) for c in cells], batches)]


def score(docs: DataFrame, mod: int = 7, rest: int = 2, order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The contract's columns for every row, learning from rows whose crc32(doc_id) mod `mod` is not `rest`.

    Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, and one end.  base_score is the
    add-one unigram score, `score` the tree's; all unknown words are one symbol in both.  A null or
    empty text is its end alone.  Repeated rows count, and are scored, each for itself; without
    training rows every count is 0 and both scores are 0.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    _, size = text_bytes(docs)
    held = docs.withColumn("held_out", held_out(F.col("doc_id"), mod, rest))
    rows, batches, parts = batched(held.mapInArrow(_packed_texts, "doc_id bigint, text binary, held_out boolean"), batch_bytes, size=size)
    buckets = -(-batches // BATCHES_PER_BUCKET)
    by_batch = rows.groupBy("_batch")
    shape = "bucket bigint, batch bigint, cell binary"
    none = [F.lit(None).cast("bigint").alias(c) for c in ("n", "v")]

    def ask_words(key: tuple, t: pa.Table) -> pa.Table:
        b = _Batch(t)
        return asks(key[0].as_py(), b.word_runs(buckets), lambda x, y: _packed(b.word_cell(x, y)))

    def ask_pairs(length: int):
        def ask(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
            if not t.num_rows:
                return ASK.empty_table()
            b = _Batch(t, told)
            b.climb(buckets, length - 1)
            return asks(key[0].as_py(), b.pair_runs(buckets), lambda x, y: _packed(b.pair_cell(x, y)))

        return ask

    def judge(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _JUDGED.empty_table()
        b = _Batch(t, told)
        b.climb(buckets, order)
        first = b.bounds[:-1]
        base = np.log10((b.known + 1.0) / (b.n + b.v + 1.0))
        sums = [np.diff(b.bounds), np.add.reduceat((b.known > 0).astype(np.int64), first), np.full(len(first), b.n), np.add.reduceat(base, first), np.add.reduceat(np.log10(b.p), first)]
        return pa.table([t["doc_id"], t["held_out"], *map(pa.array, sums)], schema=_JUDGED)

    asked = by_batch.applyInArrow(ask_words, shape)
    heard = answered(asked, min(parts, buckets), _answer(_counts)).select(F.lit(0).alias("phase"), "bucket", "batch", "cell", *none)
    # Two numbers of the whole corpus, told to every batch.
    totals = asked.repartition(min(parts, buckets), "bucket").groupBy("bucket").applyInArrow(_totals, "n bigint, v bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    # Answers are laid out by batch once; a union of what is laid out alike is too, so later steps read the same exchanges.
    told = heard.repartition(parts, "batch").unionByName(totals.select(F.lit(-1).alias("phase"), F.lit(-1).cast("bigint").alias("bucket"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(batches - 1).cast("bigint"))).alias("batch"), F.lit(None).cast("binary").alias("cell"), "n", "v").repartition(parts, "batch"))
    for k in range(1, order + 1):
        asked = by_batch.cogroup(told.groupBy("batch")).applyInArrow(ask_pairs(k), shape)
        told = told.unionByName(answered(asked, min(parts, buckets), _answer(_nodes)).select(F.lit(k).alias("phase"), "bucket", "batch", "cell", *none).repartition(parts, "batch"))
    return by_batch.cogroup(told.groupBy("batch")).applyInArrow(judge, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
