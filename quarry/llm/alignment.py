"""Alignment of two tokenizers by byte-owner arrays.

Both encodings of a text spell the same bytes.  np.repeat of token places over the bytes of each gives
two owner arrays: the A token and the B token of every byte.  Where either owner changes a new link
begins, a pair of tokens whose byte ranges overlap; where both change at once the text is cut into
groups.  Many texts are aligned in one expression, since a text's end changes both owners.

Neither tokenizer joins a space to what stands before it: A's pattern takes a space only as the first
character of a piece (but for runs of white space), and no piece of B has one after another character.
So both cut before a single space between two other characters, and a text is a row of parts that are
encoded and aligned alike wherever they stand.  A run of texts aligns each distinct part once.

How often an id pair is linked in the whole corpus is counted by run: a run's distinct pairs and their
counts are summed by pair, and the totals of the pairs that it asked for go back to the run.  So a
pair that every text holds is one row for each run, not for each text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.arrowtext import small_batches
from quarry.llm.batches import in_runs
from quarry.llm.bpe import byte_characters
from quarry.llm.tables import written

#: Arrow bytes of a run of texts, whose pairs are counted together.
RUN_BYTES = 8 << 20
#: Bytes of text that are encoded and aligned at once; one longer text is handled whole.
AT_ONCE = 1 << 19

#: `parts` are places among the run's parts; the other three stand in a run's first row alone: its
#: distinct pairs, their counts, and (part, place among the pairs) of every link of a part.
ROWS = "run bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, parts binary, pairs array<bigint>, counts array<bigint>, linked binary"
SPANS = "doc_id bigint, groups array<struct<first:bigint,last:bigint,a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>"


#: A space between two characters that are no white space (Python's is wider than either tokenizer's).
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s\s|\A\s|\s\Z")


def parts_of(text: str) -> list[str]:
    """Parts that, each after a space, spell space and text; both tokenizers cut between them.

    B writes U+2581 for a space, so a text that has one is not cut.
    """
    if "▁" in text:
        return [text]
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class Vocabulary:
    """The bytes of each token, back to back: those of id i are `data[start[i]:start[i] + size[i]]`."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size

    def lengths(self, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Bytes of each text, of which each has so many of the ids."""
        at = np.concatenate([[0], np.cumsum(self.size[ids])])
        ends = np.cumsum(many)
        return at[ends] - at[ends - many]

    def spelt(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.cumsum(size) - size
        return self.data[np.arange(int(size.sum())) + np.repeat(self.start[ids] - at, size)]


class Pair:
    """Both tokenizers, made from the contents of their files."""

    def __init__(self, a: bytes, b: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = {c: k for k, c in enumerate(byte_characters())}
        names = {i: t for t, i in json.loads(a)["model"]["vocab"].items()}
        special = {t["id"]: t["content"].encode() for t in json.loads(a)["added_tokens"]}
        spell = lambda t: bytes(byte[c] for c in t)
        self.of_a = Vocabulary([special[i] if i in special else spell(names[i]) for i in range(max([*names, *special]) + 1)])
        piece = lambda i: bytes([int(self.b.IdToPiece(i)[3:-1], 16)]) if self.b.IsByte(i) else self.b.IdToPiece(i).replace("▁", " ").encode()
        self.of_b = Vocabulary([piece(i) for i in range(self.b.GetPieceSize())])
        if any("▁" in self.b.IdToPiece(i).lstrip("▁") for i in range(self.b.GetPieceSize())):
            raise ValueError("a piece of B goes on over a space: texts cannot be cut there")
        self.shown_a = [f"{i}{end}" for i in range(len(self.of_a.size)) for end in (",", "|")]
        self.shown_b = [f"{i}{end}" for i in range(len(self.of_b.size)) for end in (",", ";")]
        self.shown = np.array(self.shown_a + self.shown_b, object)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B; a text whose bytes they do not both spell has none."""
        a = [e.ids for e in self.a.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        data = [f" {t}".encode("utf-8", "replace") if t else b"" for t in texts]
        whole, size = np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data))
        spelt = [(v.spelt(flat), v.lengths(flat, n)) for v, (flat, n) in ((self.of_a, _flat(a)), (self.of_b, _flat(b)))]
        if all(np.array_equal(n, size) and np.array_equal(x, whole) for x, n in spelt):
            return a, b
        for x, n in spelt:  # one text is odd at least: each by itself
            at = np.concatenate([[0], np.cumsum(n)])
            for k, own in enumerate(data):
                if x[at[k] : at[k + 1]].tobytes() != own:
                    data[k] = None
        return [[] if x is None else i for x, i in zip(data, a)], [[] if x is None else i for x, i in zip(data, b)]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, ids of each text)."""
    return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


class Aligned:
    """Texts aligned at once.  Places of tokens, links and groups count over all of them."""

    def __init__(self, pair: Pair, texts: list[str]) -> None:
        (self.a, self.n_a), (self.b, self.n_b) = map(_flat, pair.encode(texts))
        owner_a = np.repeat(np.arange(len(self.a)), pair.of_a.size[self.a])
        owner_b = np.repeat(np.arange(len(self.b)), pair.of_b.size[self.b])
        new_a, new_b = np.ones(len(owner_a), bool), np.ones(len(owner_b), bool)
        new_a[1:], new_b[1:] = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
        at = np.flatnonzero(new_a | new_b)
        self.link_a, self.link_b = owner_a[at], owner_b[at]  # places of the linked tokens
        self.cut = np.flatnonzero(new_a & new_b)  # first byte of each group
        self.group_a = np.searchsorted(self.cut, np.flatnonzero(new_a), "right") - 1  # group of each token
        self.group_b = np.searchsorted(self.cut, np.flatnonzero(new_b), "right") - 1
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        # Links and groups of each text: by its tokens' places, of which an empty text has none.
        self.first_link = np.searchsorted(self.link_a, self.first_a)
        ends = np.concatenate([self.group_a, [len(self.cut)]])
        self.first_group = ends[self.first_a]

    def shown(self, pair: Pair) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: A's ids and B's, group by group."""
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True]]) if len(g) else np.zeros(0, bool) for g in (self.group_a, self.group_b))
        # A's tokens of a group come before B's: each goes behind what earlier groups, and A here, have.
        before_b = np.searchsorted(self.group_b, self.group_a, "left")
        before_a = np.searchsorted(self.group_a, self.group_b, "right")
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + before_b] = self.a * 2 + last_a
        order[np.arange(len(self.b)) + before_a] = len(pair.shown_a) + self.b * 2 + last_b
        names = pair.shown[order].tolist()
        for lo, hi in zip((self.first_a + self.first_b).tolist(), (self.first_a + self.first_b)[1:].tolist()):
            yield "".join(names[lo:hi])[:-1]


#: The tokenizers that a Python worker has made: the latest pair only.
_LOADED: dict[bytes, Pair] = {}


def _shared(docs: DataFrame, a_file: str, b_file: str):
    """Both files' contents as a broadcast: their size is the vocabularies', whatever the corpus."""
    a, b = Path(a_file).read_bytes(), Path(b_file).read_bytes()
    return docs.sparkSession.sparkContext.broadcast((a, b, hashlib.sha256(a + b).digest()))


def _worker(shared) -> Pair:
    a, b, key = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pair(a, b)
    return _LOADED[key]


def _slices(texts: list[str | None]) -> Iterator[list[str]]:
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t or "")
        size += len(t or "")
        if size >= AT_ONCE:
            yield some
            some, size = [], 0
    if some:
        yield some


def _columns(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, groups and links of every text.

    A encodes a space and the text, B the text, to which it adds that space; special tokens inside
    texts are plain text.  A group is the shortest run of bytes at whose ends tokens of both end:
    its first and last byte in space and text, and the ids of both.  A link holds the places of two
    tokens whose byte ranges overlap.  A null or empty text, and one whose bytes either encoding
    does not give back (A's and B's must both be space and text), has no groups and no links.  Rows
    that repeat, and null ids, are rows as any other; other columns are left out; an empty table
    gives no rows.
    """
    shared = _shared(docs, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker(shared)
        for batch in batches:
            groups, links = [], []
            for some in _slices(batch.column(1).to_pylist()):
                x = Aligned(pair, some)
                cut = [*x.cut.tolist(), int(pair.of_a.size[x.a].sum())]
                of_a = np.searchsorted(x.group_a, np.arange(len(cut))).tolist()
                of_b = np.searchsorted(x.group_b, np.arange(len(cut))).tolist()
                for k in range(len(some)):
                    g, to = int(x.first_group[k]), int(x.first_group[k + 1])
                    groups.append([{"first": cut[i] - cut[g], "last": cut[i + 1] - 1 - cut[g], "a": x.a[of_a[i] : of_a[i + 1]].tolist(), "b": x.b[of_b[i] : of_b[i + 1]].tolist()} for i in range(g, to)])
                    span = slice(x.first_link[k], x.first_link[k + 1])
                    links.append([{"a": p, "b": q} for p, q in zip((x.link_a[span] - x.first_a[k]).tolist(), (x.link_b[span] - x.first_b[k]).tolist())])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups, kind), pa.array(links, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["doc_id", "groups", "links"])

    return _columns(docs).mapInArrow(run, SPANS)


def _runs(docs: DataFrame, a_file: str, b_file: str, run_bytes: int) -> DataFrame:
    """ROWS of every text."""
    shared = _shared(docs, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _worker(shared)
        ids_b = len(pair.of_b.size)
        for number, t in in_runs(batches, run_bytes):
            place: dict[str, int] = {}
            held = [np.array([place.setdefault(p, len(place)) for p in parts_of(x)], np.int64) if x else np.zeros(0, np.int64) for x in t["text"].to_pylist()]
            sizes, shown, codes, owners, base = [np.zeros((4, 0), np.int64)], [], [], [], 0
            for some in _slices(list(place)):
                x = Aligned(pair, some)
                sizes.append(np.stack([x.n_a, x.n_b, np.diff(x.first_group), np.diff(x.first_link)]))
                shown += x.shown(pair)
                codes.append(x.a[x.link_a] * ids_b + x.b[x.link_b])
                owners.append(np.repeat(np.arange(len(some)), sizes[-1][3]) + base)
                base += len(some)
            size = np.concatenate(sizes, axis=1)
            # A text with a part that does not come back has no tokens at all.
            held = [h if size[0, h].all() else h[:0] for h in held]
            often = np.bincount(np.concatenate(held), minlength=base)
            code, owner = np.concatenate([*codes, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
            used = often[owner] > 0
            code, owner = code[used], owner[used]
            pairs, at = np.unique(code, return_inverse=True)
            counts = np.bincount(at, weights=often[owner], minlength=len(pairs)).astype(np.int64)
            rest = [None] * (len(held) - 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(held), number)),
                    t["doc_id"].combine_chunks(),
                    *(pa.array([int(n[h].sum()) for h in held], pa.int64()) for n in size),
                    pa.array([hashlib.sha256(";".join([shown[p] for p in h.tolist()]).encode()).hexdigest() if len(h) else "" for h in held], pa.string()),
                    pa.array([h.astype("<u4").tobytes() for h in held], pa.binary()),
                    pa.array([pairs.tolist(), *rest], pa.list_(pa.int64())),
                    pa.array([counts.tolist(), *rest], pa.list_(pa.int64())),
                    pa.array([np.stack([owner, at]).astype("<u4").tobytes(), *rest], pa.binary()),
                ],
                names=["run", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "parts", "pairs", "counts", "linked"],
            )

    return _columns(docs).mapInArrow(run, ROWS)


def digest(docs: DataFrame, a_file: str, b_file: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum.

    A pair's count is the number of links of the corpus that hold its two ids; count_sum adds the
    counts of a text's links, and n_best are those whose count is the highest of all pairs of their
    B id, ties included.  Rows without tokens have zeros and an empty groups_sha256 (see `align`).
    """
    rows = written(_runs(docs, a_file, b_file, run_bytes))  # encoded once; run numbers are fixed from here on
    asked = rows.where("pairs is not null").select("run", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")).select("run", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    ids_b = F.lit(_vocabulary_size(b_file))
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total"))
    # A B id has as many pairs as A has ids, at most.
    best = F.max("total").over(Window.partitionBy(F.col("pair") % ids_b))
    totals = totals.withColumn("best", F.col("total") == best)
    told = asked.select("run", "place", "pair").join(totals, "pair").select(F.col("run").alias("asker"), "place", "total", "best")

    def answer(key: tuple, t: pa.Table, told: pa.Table) -> pa.Table:
        place = told["place"].to_numpy()
        value = np.zeros((2, len(place)), np.int64)  # of each pair: whether it is the best, and its count
        value[:, place] = told["best"].to_numpy(), told["total"].to_numpy()
        held = [np.frombuffer(x, "<u4") for x in t["parts"].to_pylist()]
        owner, at = np.frombuffer(next(x for x in t["linked"].to_pylist() if x is not None), "<u4").reshape(2, -1)
        parts = max((int(h.max()) for h in held if len(h)), default=-1) + 1
        sums = []
        for v in value:
            of_part = np.zeros(parts, np.int64)
            np.add.at(of_part, owner, v[at])
            sums.append(pa.array([int(of_part[h].sum()) for h in held], pa.int64()))
        return pa.table([*(t[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *sums], names=names)

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    return rows.drop("pairs", "counts").groupBy("run").cogroup(told.groupBy("asker")).applyInArrow(answer, schema)


def _vocabulary_size(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).GetPieceSize()
