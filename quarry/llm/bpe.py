"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token sequences: one state per token, one arc per token that may follow.  It
starts as a single state in which every base symbol may follow every other; each merge (u, v) -> w,
in order, adds a gadget: after u the arc v is cut, and wherever an arc u leaves a new arc w leaves
too, into the state that v had led to.  In the end each string has exactly one path: its encoding.
The gadgets cut few arcs, so the cuts are kept with the merge's rank and, for each token, the state
it was split from and when; an arc is worked out once from them and then kept.

Arcs are spelt by symbols in one table, (place in a label, symbol) -> next place.  Words are encoded
in lanes, a symbol at a time: every label begun in a lane takes its transition, and since a prefix
has exactly one path too, just one of the labels that end may leave the state it began in.  That
token is the state at this place; nothing is tried and taken back.  The path is read from the end.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import small_batches

#: White-space chunks in one of two generations that a Python worker keeps: a chunk of the older one
#: moves over when it is met.  Arcs between tokens that it keeps at most.
CHUNKS_KEPT = 90_000
ARCS_KEPT = 400_000
#: Symbols of a word encoded in lanes; longer ones are encoded one by one.
LANE = 40
#: Characters of text handled at once; a longer text is handled whole.
AT_ONCE = 1 << 20
_NEVER = 1 << 60
#: A word's last byte is a symbol of its own.
_LAST = 256
_BITS = 9
#: The arc that leads into any token: a word's first.
_ANY = -1


def byte_characters() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class _Table:
    """A map from numbers of 0 or more to numbers, read by whole arrays; -1 stands for none."""

    def __init__(self, entries: dict[int, int]) -> None:
        key = np.fromiter(entries, np.int64, len(entries))
        value = np.fromiter(entries.values(), np.int32, len(entries))
        self.shift = np.uint64(64 - max(4, (4 * len(key)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.key, self.value = np.full(size + len(key), -1, np.int64), np.full(size + len(key), -1, np.int32)
        at = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.key[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.key[slots], self.value[slots] = key[free[first]], value[free[first]]
            left = self.key[at] != key
            key, value, at = key[left], value[left], at[left] + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __getitem__(self, key: np.ndarray) -> np.ndarray:
        out, at, where = np.full(len(key), -1, np.int32), self._slot(key), np.arange(len(key))
        while len(where):
            have = self.key[at]
            hit = have == key
            out[where[hit]] = self.value[at[hit]]
            on = ~hit & (have >= 0)
            key, at, where = key[on], at[on] + 1, where[on]
        return out


class Automaton:
    def __init__(self, file: str) -> None:
        with open(file, "rb") as f:
            data = f.read()
        spec = json.loads(data)
        #: What a worker knows the tokenizer by: two that share a pattern and a size are not one.
        self.name = hashlib.sha256(data).hexdigest()
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.born: dict[int, tuple[int, int, int]] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(map(lambda m: m if isinstance(m, list) else m.split(" "), model["merges"])):
            self._gadget(rank, model["vocab"][u], model["vocab"][v], model["vocab"][u + v])
        self._spell(model["vocab"])

    def _spell(self, vocabulary: dict[str, int]) -> None:
        """Labels as paths over symbols: `step` (place, symbol) -> place, `ends` the token of a place."""
        byte = {c: b for b, c in enumerate(byte_characters())}
        self.step: dict[int, int] = {}
        ends = [-1]
        for label, token in vocabulary.items():
            last = label.endswith(self.suffix)
            symbols = [byte.get(c) for c in (label[: -len(self.suffix)] if last else label)]
            if not symbols or None in symbols:
                continue  # no label that text spells
            symbols[-1] += _LAST * last
            place = 0
            for c in symbols:
                to = self.step.setdefault(place << _BITS | c, len(ends))
                if to == len(ends):
                    ends.append(-1)
                place = to
            ends[place] = token
        self.ends = np.array(ends, np.int32)

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Cut arc v after u; arc w leaves wherever u does, into a state split from v's as it is now."""
        if (u, v) in self.cut or w in self.born:
            raise ValueError("a pair is merged twice, or a token made twice")
        self.cut[u, v] = rank
        self.born[w] = (rank, u, v)

    def follows(self, state: int, token: int) -> bool:
        """Whether the arc `token` leaves the state after `state`, by the gadgets on both lineages."""
        t, until = token, _NEVER
        while True:
            s, before = state, _NEVER
            while True:
                r = self.cut.get((s, t))
                if r is not None and r <= until and r < before:
                    return False
                if s not in self.born:
                    break
                before, _, s = self.born[s]
            if t not in self.born:
                return True
            until, t, _ = self.born[t]

    def ready(self) -> Automaton:
        """What a worker keeps: the table as arrays, arcs, chunks."""
        self.find = regex.compile(self.pattern).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.space = regex.compile(r"\p{White_Space}+").split
        self.odd = regex.compile("[\x1c-\x1f]").search  # split() ends a word there, the pattern does not
        self.table = _Table(self.step)
        self.arcs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        gc.freeze()  # none of this is garbage: leave it out of every collection
        return self

    def _arc(self, state: int, token: int) -> bool:
        key = state * len(self.label) + token
        got = self.arcs.get(key)
        if got is None:
            if len(self.arcs) >= ARCS_KEPT:
                self.arcs.clear()
            got = self.arcs[key] = self.follows(state, token)
        return got

    def words(self, pieces: list[str]) -> list[list[int]]:
        """The one path that spells each piece."""
        raw = [p.encode("utf-8", "replace") for p in pieces]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[list[int]] = [[]] * len(raw)
        for i in np.flatnonzero(size > LANE).tolist():
            out[i] = self._long(raw[i])
        order = np.flatnonzero((size > 0) & (size <= LANE))
        order = order[np.argsort(-size[order], kind="stable")]  # the lanes still open come first
        if len(order):
            for i, path in zip(order.tolist(), self._lanes([raw[i] for i in order.tolist()], size[order])):
                out[i] = path
        return out

    def _lanes(self, raw: list[bytes], size: np.ndarray) -> list[list[int]]:
        n, longest = len(raw), int(size[0])
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        at = np.cumsum(size) - size
        flat[at + size - 1] += _LAST
        token = np.full((longest + 1, n), -1, np.int64)  # the token that ends before each place
        length = np.zeros((longest + 1, n), np.int64)
        lane, start, place = (np.zeros(0, np.int64) for _ in range(3))
        arcs = self.arcs
        arcs[_ANY] = True
        for i in range(longest):
            still = int(np.searchsorted(-size, -i))  # lanes of more than i symbols
            symbol = flat[at[:still] + i]
            on = lane < still
            lane = np.concatenate([lane[on], np.arange(still)])
            start = np.concatenate([start[on], np.full(still, i)])
            place = np.concatenate([place[on], np.zeros(still, np.int64)])
            place = self.table[place << _BITS | symbol[lane]].astype(np.int64)
            on = place >= 0
            lane, start, place = lane[on], start[on], place[on]
            ended = self.ends[place].astype(np.int64)
            k = np.flatnonzero(ended >= 0)
            t, q = ended[k], token[start[k], lane[k]]
            pair = np.where(start[k] > 0, q * len(self.label) + t, _ANY)
            key, back = np.unique(pair, return_inverse=True)
            key = key.tolist()
            have = [self._arc(*divmod(x, len(self.label))) if h is None else h for x, h in zip(key, map(arcs.get, key))]
            k = k[np.array(have, bool)[back]]
            if len(k) != still:
                raise ValueError("not one path: the vocabulary lacks a byte or the merges are not in order")
            token[i + 1, lane[k]] = ended[k]
            length[i + 1, lane[k]] = i + 1 - start[k]
        token, length = token.T.tolist(), length.T.tolist()
        return [self._back(t, s, e) for t, s, e in zip(token, length, size.tolist())]

    @staticmethod
    def _back(token: list[int], length: list[int], at: int) -> list[int]:
        path = []
        while at:
            path.append(token[at])
            at -= length[at]
        path.reverse()
        return path

    def _long(self, raw: bytes) -> list[int]:
        """One word by the same transitions, without arrays."""
        token, length, begun = [-1], [0], []
        for i, c in enumerate(raw):
            symbol = c + _LAST * (i == len(raw) - 1)
            still, found = [], None
            for start, place in [*begun, (i, 0)]:
                place = self.step.get(place << _BITS | symbol)
                if place is None:
                    continue
                still.append((start, place))
                t = int(self.ends[place])
                if t >= 0 and (start == 0 or self._arc(token[start], t)):
                    found = t, i + 1 - start
            if found is None:
                raise ValueError("a byte is missing in the vocabulary")
            begun = still
            token.append(found[0])
            length.append(found[1])
        return self._back(token, length, len(raw))

    def pieces(self, text: str) -> list[str]:
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def decode(self, ids: list[int]) -> str:
        """Arc labels in order; the vocabulary's decoder joins them by one space."""
        return " ".join([self.label[i] for i in ids])

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        for s in self.parts(text) if self.parts and "<|" in text else (text,):
            yield s, self.special.get(s)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for s, special in self.segments(text or ""):
            out += [special] if special is not None else [t for path in self.words(self.pieces(s)) for t in path]
        return out

    def digest(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Tokens, ids and decoded text of each, by white-space chunks: no piece and no composition spans two."""
        some: list[str | None] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t or "")
            if size >= AT_ONCE:
                yield from self._digest(some)
                some, size = [], 0
        yield from self._digest(some)

    def _digest(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        split = []
        if len(self.chunks) > CHUNKS_KEPT:
            self.older, self.chunks = self.chunks, {}
        have, older, fresh = self.chunks, self.older, []
        have.update((s, (1, str(t), s)) for s, t in self.special.items())
        for text in texts:
            own: list[str] = []
            for s, special in self.segments(text or ""):
                if special is not None:
                    own.append(s)
                else:
                    own += self.space(s) if self.odd(s) else s.split()
            split.append(own)
            for c in set(own).difference(have):
                if (got := older.get(c)) is None:
                    fresh.append(c)
                have[c] = got
        found = {c: self.pieces(c) for c in fresh}
        distinct = list({p for ps in found.values() for p in ps})
        paths = dict(zip(distinct, self.words(distinct)))
        show, name = str, self.label
        for c, ps in found.items():
            ids = [t for p in ps for t in paths[p]]
            have[c] = len(ids), " ".join(map(show, ids)), " ".join([name[i] for i in ids])
        for own in split:
            n, ids, shown = zip(*map(have.__getitem__, own)) if own else ((), (), ())
            if 0 in n:
                ids, shown = ([x for x, k in zip(xs, n) if k] for xs in (ids, shown))
            yield sum(n), " ".join(ids), " ".join(shown)
        for c in fresh:
            if len(c) > LANE:
                del have[c]


#: The automaton that a Python worker has made ready: the latest one only.
_LOADED: dict[str, Automaton] = {}


def _shared(docs: DataFrame, file: str):
    """The compiled automaton as a broadcast: its size is the vocabulary's, whatever the corpus."""
    a = Automaton(file)
    for t, i in a.special.items():
        a.label[i] = t
    return docs.sparkSession.sparkContext.broadcast(a)


def _worker(shared) -> Automaton:
    key = shared.value.name
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = shared.value.ready()
    return _LOADED[key]


def encode(docs: DataFrame, file: str) -> DataFrame:
    """doc_id and token_ids (array<int>) of every text; a null or empty text has no tokens."""
    small_batches(docs.sparkSession)
    shared = _shared(docs, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _worker(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "token_ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, token_ids array<int>")


def decode(tokens: DataFrame, file: str) -> DataFrame:
    """doc_id and the decoded text of token_ids, in their order; null and no ids give an empty text.

    A null id, and one outside the vocabulary, is an error.
    """
    shared = _shared(tokens, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _worker(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.decode(t or []) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return tokens.select("doc_id", "token_ids").mapInArrow(run, "doc_id bigint, decoded string")


def digest(docs: DataFrame, file: str) -> DataFrame:
    """n_tokens and the sha256 of ids and decoded text of every row, nothing else leaving Python.

    A null or empty text has no tokens and the digests of empty strings; rows that repeat stay rows;
    columns other than doc_id and text are left out; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = _shared(docs, file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _worker(shared)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()
        for b in batches:
            got = [*a.digest(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([sha(i) for _, i, _ in got]), pa.array([sha(d) for _, _, d in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
