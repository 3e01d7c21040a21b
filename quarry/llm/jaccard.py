"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. Each text becomes the sorted array of its distinct shingle hashes.  Texts with equal sets are one
   class from there on.
2. The corpus counts in how many classes each shingle occurs, and a class orders its shingles from
   rare to frequent.  Two sets of at least the wanted similarity share one of the first
   n - ceil(t n) + 1 shingles of both, so only those that more than one class holds are looked at.
3. Classes joined by such shingles make up a tile; a large tile is cut into bands of size, and bands
   into blocks, whose pairs are tiles of their own.
4. In a tile, a pair is passed over if its sizes or the bit counts of its hashed bitmaps leave no
   room for the needed overlap, or if both are linked already; the rest are intersected exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import LOWER, SPACE, mix, split_words, text_chunks, window_hashes, word_hashes
from quarry.llm.batches import BATCH_BYTES, answered, asks, batched, by_bucket
from quarry.llm.components import components
from quarry.llm.tables import written

#: Classes of one tile, or of one block of a cut one.
TILE = 2048
#: Bits of a bitmap: twice the largest set of the tile, within these.
BITS = (512, 1 << 15)


def shingle_sets(t: pa.Table, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text.

    Words are runs without `[\\x20\\x09-\\x0D]`, A-Z lower-cased.  Fewer words than `size`, but not
    none, are one shingle.
    """
    out = []
    for _, raw, off in text_chunks(t["text"]):
        raw = LOWER[raw]
        starts, ends, edge = split_words(raw, off, SPACE)
        words = word_hashes(raw, starts, ends)
        every = window_hashes(words, size)
        for a, b in zip(edge, edge[1:]):
            if b - a >= size:
                out.append(np.unique(every[a : b - size + 1]))
            elif b > a:
                out.append(window_hashes(words[a:b], int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, draw, n_shingles, class for every row; class is null for an empty set."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(pa.Table.from_batches([b]), size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.binary())], names=["doc_id", "draw", "n_shingles", "class"])

    return docs.select("doc_id", "text", "draw").mapInArrow(run, "doc_id bigint, draw bigint, n_shingles bigint, class binary")


class _Batch:
    """The classes that a batch speaks for, and their distinct shingles."""

    def __init__(self, t: pa.Table, told: pa.Table, size: int) -> None:
        mine = {c for c, k in zip(told["cell"].to_pylist(), told["bucket"].to_pylist()) if k == -1}
        self.sets, self.names = [], []
        for s in shingle_sets(t.select(["text"]), size):
            c = class_of(s)
            if c in mine:
                mine.discard(c)
                self.sets.append(s)
                self.names.append(c)
        held = np.concatenate([*self.sets, np.zeros(0, np.uint64)])
        self.shingles, count = np.unique(held, return_counts=True)
        self.count = np.minimum(count, 255).astype(np.uint8)

    def runs(self, buckets: int) -> tuple:
        return by_bucket(self.shingles, buckets)

    def cell(self, a: int, b: int) -> bytes:
        """Five hash bytes and a count of up to 255 for each shingle."""
        low = self.shingles[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        return np.column_stack([low, self.count[a:b]]).tobytes()


def _frequency(cells: list[bytes], _: list[int]) -> list[bytes]:
    """For each batch's shingles: 0 if only one class of the corpus has it, else 1 + log2 of their number.

    Shingles of one bucket that agree in five bytes count together: that moves a shingle's place in
    the order, the same for all, and loses no pair.
    """
    parts = [np.frombuffer(c, np.uint8).reshape(-1, 6) for c in cells]
    every = np.concatenate(parts)
    wide = np.zeros((len(every), 8), np.uint8)
    wide[:, :5] = every[:, :5]
    _, at = np.unique(wide.view("<u8").ravel(), return_inverse=True)
    total = np.bincount(at, weights=every[:, 5])
    code = np.where(total > 1, 1 + np.log2(np.maximum(total, 1)), 0).astype(np.uint8)[at]
    return [x.tobytes() for x in np.split(code, np.cumsum([len(p) for p in parts])[:-1])]


def tile_links(sets: list[np.ndarray], label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that join up everything the tile's links join: pairs of one label are passed over.

    Sets come in ascending size.  `label` holds small integers, equal for sets known to be joined.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    bits = min(BITS[1], max(BITS[0], 1 << int(2 * n.max() - 1).bit_length()))
    maps = np.zeros((m, bits), bool)
    for i, s in enumerate(sets):
        maps[i, (mix(s) % np.uint64(bits)).astype(np.int64)] = True
    maps = np.packbits(maps, axis=1).view(np.uint64)
    label, out = label.copy(), []
    for i in range(1, m):
        lo = int(np.searchsorted(n[:i], -(-num * n[i] // den)))
        j = lo + np.flatnonzero(label[lo:i] != label[i])
        if not len(j):
            continue
        apart = np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1, dtype=np.int64)
        most = (n[j] + n[i] - apart) // 2
        need = -(-num * (n[j] + n[i]) // (num + den))
        fit = most >= need
        j, most, need = j[fit], most[fit], need[fit]
        for k in np.argsort(-most, kind="stable"):
            if label[j[k]] == label[i]:
                continue
            x, y = sets[j[k]], sets[i]
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            if both >= need[k]:
                out.append((int(j[k]), i))
                label[label == label[i]] = label[j[k]]
    return out


def _linked(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) class links found in each group of `tile`."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["n"].to_pylist(), t["class"].to_pylist(), t["hashes"].to_pylist(), t["label"].to_pylist()))
        sets = [np.frombuffer(h, np.uint64) for _, _, h, _ in rows]
        known = {x: i for i, x in enumerate(dict.fromkeys(x for *_, x in rows))}
        links = tile_links(sets, np.array([known[x] for *_, x in rows]), num, den)
        return pa.table([pa.array([rows[a][1] for a, _ in links], pa.binary()), pa.array([rows[b][1] for _, b in links], pa.binary())], names=["u", "v"])

    return tiles.select("tile", "class", "n", "hashes", "label").groupBy("tile").applyInArrow(run, "u binary, v binary")


def _links(found: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Class links that join exactly what all links join.  `found` holds token and set rows."""
    # Every shingle's holders hang on the smallest of them: as many rows as holders, not pairs.
    tokens = found.where("token is not null").select("token", "class")
    first = tokens.groupBy("token").agg(F.min("class").alias("v"))
    roots = components(tokens.join(first, "token").select(F.col("class").alias("u"), "v"))
    sets = found.where("hashes is not null").select("class", "n", "hashes")
    sets = sets.join(roots.select(F.col("node").alias("class"), "root"), "class")
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    sets = written(sets.join(sizes, "root"))
    alone = F.col("class")
    small = _linked(sets.where(F.col("members") <= tile).select(F.col("root").alias("tile"), "class", "n", "hashes", alone.alias("label")), num, den)
    large = sets.where(F.col("members") > tile)
    if large.isEmpty():
        return small
    # Bands: a link's sizes lie in one band or two neighbours.  Blocks: a band cut evenly by hash.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    large = large.withColumn("band", band)
    held = large.groupBy("root", "band").agg(F.count("*").alias("held"))
    blocks = F.ceil(F.col("held") / (tile // 2)).cast("int")
    large = written(large.join(held, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")))
    inner = written(_linked(large.select(F.struct("root", "band", "block").alias("tile"), "class", "n", "hashes", alone.alias("label")), num, den))
    joined = components(inner)
    large = large.join(joined.select(F.col("node").alias("class"), F.col("root").alias("joined")), "class", "left").withColumn("label", F.coalesce("joined", "class"))
    # A block meets the others of its band and of both neighbours.  Pairs that the blocks' own links
    # join are passed over, so copies of one text cost one comparison for each pair of blocks.
    counts = held.select("root", F.col("band").alias("b"), blocks.alias("k"))
    at = large.select("root", "band", "block").distinct()
    met = at.join(counts, "root").where("abs(b - band) <= 1").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    here, there = F.struct("band", "block"), F.struct(F.col("b").alias("band"), F.col("o").alias("block"))
    met = met.where(here != there).select("root", "band", "block", F.struct("root", F.least(here, there).alias("x"), F.greatest(here, there).alias("y")).alias("tile"))
    outer = _linked(large.join(met, ["root", "band", "block"]), num, den)
    return small.unionByName(inner).unionByName(outer)


def join(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, batch_bytes: int = BATCH_BYTES, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id for every input row.

    Two rows link when den * |A & B| >= num * |A | B| for their sets of distinct `shingle`-word
    shingles; component_id is the smallest doc_id reachable by links.  A null text, an empty one and
    one without words has no shingles, links with nothing and keeps its own doc_id.  Equal rows link
    as equal sets do; rows that share a doc_id are told apart by their sets.  A null doc_id counts
    as larger than any other.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    draw = F.xxhash64("doc_id", "text")  # rows of one id are spread by their texts
    rows = written(_classes(docs.withColumn("draw", draw), shingle))
    speaker = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "draw")).alias("s")
    speakers = rows.where("class is not null").groupBy("class").agg(speaker).select("class", "s.doc_id", "s.draw")
    docs, buckets, parts = batched(docs, batch_bytes, draw)
    docs = docs.withColumnRenamed("_batch", "batch")
    batch = F.pmod("draw", F.lit(buckets)).cast("bigint")
    mine = speakers.select(F.lit(-1).cast("bigint").alias("bucket"), batch.alias("batch"), F.col("class").alias("cell"))

    def ask(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(t, told, shingle)
        return asks(key[0].as_py(), b.runs(buckets), b.cell)

    def show(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        b = _Batch(t, told, shingle)
        cells = dict(zip(told["bucket"].to_pylist(), told["cell"].to_pylist()))
        code = np.zeros(len(b.shingles), np.uint8)
        for k, lo, hi in zip(*b.runs(buckets)):
            code[lo:hi] = np.frombuffer(cells[k], np.uint8)
        token, names, n, hashes = [], [], [], []
        for name, s in zip(b.names, b.sets):
            c = code[np.searchsorted(b.shingles, s)]
            first = np.lexsort((s, c))[: prefix_length(len(s), num, den)]
            first = first[c[first] > 0]
            if len(first):
                token += [*s[first].view(np.int64).tolist(), None]
                names += [name] * (len(first) + 1)
                n += [len(s)] * (len(first) + 1)
                hashes += [None] * len(first) + [s.tobytes()]
        return pa.table([pa.array(token, pa.int64()), pa.array(names, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.binary())], names=["token", "class", "n", "hashes"])

    told = mine.repartition(parts, "batch")
    asked = docs.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask, "bucket bigint, batch bigint, cell binary")
    known = answered(asked, parts, _frequency).unionByName(mine).repartition(parts, "batch")
    found = written(docs.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(show, "token bigint, class binary, n bigint, hashes binary"))
    groups = components(_links(found, num, den, tile)).select(F.col("node").alias("class"), "root")
    classes = speakers.join(groups, "class", "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    least = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = classes.join(least, "root").select("class", "component_id")
    return rows.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


#: DuckDB SQL of `join`.  Pairs are found by shared shingles, links walked to the smallest id.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 2), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""
