"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs, in numpy.

A word's input is its own embedding, if the training sample has it often enough, beside the mean
embedding of its character n-grams.  A window of words runs through a GRU in both directions,
attention pools the states, and a linear layer gives the window's logit.  A document's score is the
calibrated logit of its most toxic window; windows overlap and cover the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import LOWER, NOT_ALNUM, mix, small_batches, split_words, text_chunks, word_hashes
from quarry.llm.langid import held_out

#: Words of a window and between two window starts.
SPAN, STRIDE = 16, 8
#: The training sample: documents of each class at most, by the smallest hashes of their ids, and
#: windows of one document at most, spread evenly over it.
TOXIC_DOCS, CLEAN_DOCS = 800, 2400
TOXIC_WINDOWS, CLEAN_WINDOWS = 48, 24
#: Of so many documents of the sample one serves calibration only.
CALIBRATION = 4
#: Documents of the sample that a word must be in to have an embedding of its own.
WORD_DOCS = 6
GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
WORD_DIM = CHAR_DIM = STATE = ATTEND = 8
#: Passes over the windows chosen in each phase, and their learning rates.
PHASES = ((3, 0.01), (2, 0.006), (2, 0.003), (2, 0.0015))
BATCH, DECAY = 256, 1e-5
#: Most likely windows of a clean document that later phases learn from, and a share of the others.
HARD, EASY = 3, 0.15
#: Windows scored by one numpy expression.
AT_ONCE = 4096


def word_grams(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every character n-gram of `<word>`, first n-gram of each word); words have some."""
    n = ends - starts
    size = n + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], ord("<"), np.int64)
    flat[at[1:] - 1] = ord(">")
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    flat[inner] = raw[np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    word = np.repeat(np.arange(len(n)), size)
    left = np.repeat(at[1:], size) - np.arange(at[-1])
    codes, words = [], []
    for k in GRAMS:
        ok = np.flatnonzero(left >= k)
        code = np.full(len(ok), k, np.uint64)
        for j in range(k):
            code = code * np.uint64(257) + flat[ok + j].astype(np.uint64)
        codes.append((mix(code) % np.uint64(BUCKETS)).astype(np.int32))
        words.append(word[ok])
    order = np.argsort(np.concatenate(words), kind="stable")
    every = np.concatenate(words)[order]
    return np.concatenate(codes)[order], np.searchsorted(every, np.arange(len(n)))


class Words:
    """Distinct words of some texts, the texts as numbers of these, and their n-grams."""

    def __init__(self, column: pa.Array) -> None:
        hashes, bounds, lengths, self.first = [], [np.zeros(1, np.int64)], [], []
        grams, heads, held, known = [], [], 0, {}
        for _, raw, off in text_chunks(column):
            raw = LOWER[raw]
            starts, ends, edge = split_words(raw, off, NOT_ALNUM)
            bounds.append(edge[1:] + bounds[-1][-1])
            if not len(starts):
                continue
            h, at, which = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
            g, head = word_grams(raw, starts[at], ends[at])
            hashes.append(h)
            lengths.append(which + held)
            grams.append(g)
            heads.append(head + sum(map(len, grams[:-1])))
            held += len(h)
        self.bounds = np.concatenate(bounds)
        self.hashes = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.ids = np.concatenate([*lengths, np.zeros(0, np.int64)])
        self.grams = np.concatenate([*grams, np.zeros(0, np.int32)])
        self.heads = np.concatenate([*heads, np.zeros(0, np.int64)])
        self.sizes = np.diff(np.concatenate([self.heads, [len(self.grams)]]))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word of each window, document of each window)."""
        n = np.diff(self.bounds)
        count = np.where(n > 0, np.maximum(0, -(-(n - SPAN) // STRIDE)) + 1, 0)
        doc = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        return self.bounds[:-1][doc] + np.minimum(k * STRIDE, np.maximum(0, n[doc] - SPAN)), doc

    def cells(self, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and mask of windows, both SPAN by windows."""
        at = first[None, :] + np.arange(SPAN)[:, None]
        mask = at < self.bounds[1:][doc][None, :]
        return self.ids[np.minimum(at, max(0, len(self.ids) - 1))], mask


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b without BLAS, whose kernels round a row differently by its place and neighbours."""
    return np.einsum("...k,kj->...j", a, b)


class Net:
    def __init__(self, vocabulary: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, STATE
        r = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": r(len(vocabulary) + 1, WORD_DIM, k=0.1), "char": r(BUCKETS, CHAR_DIM, k=0.3), "att": r(2 * h, ATTEND), "v": r(ATTEND), "w": r(2 * h), "b": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {"x" + s: r(d, 3 * h), "u" + s: r(h, 3 * h), "c" + s: np.zeros(3 * h, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(vocabulary row, input vector) of each distinct word; row 0 is for unknown words."""
        v = self.vocabulary
        at = np.searchsorted(v, w.hashes)
        row = np.where((at < len(v)) & (v[np.minimum(at, max(0, len(v) - 1))] == w.hashes), at + 1, 0) if len(v) else np.zeros(len(w.hashes), np.int64)
        chars = np.add.reduceat(self.p["char"][w.grams], w.heads, axis=0) / np.sqrt(w.sizes)[:, None] if len(w.heads) else np.zeros((0, CHAR_DIM))
        return row, np.concatenate([self.p["word"][row], chars], axis=1).astype(np.float32)

    def forward(self, x: np.ndarray, cell: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows.  `x`: input of each distinct word, `cell`: SPAN by windows.

        `keep` is for training; without it equal windows have equal logits in any company.
        """
        p, h, n = self.p, STATE, cell.shape[1]
        dot = np.matmul if keep else _product
        states = np.empty((SPAN, n, 2 * h), np.float32)
        m = mask[..., None].astype(np.float32)
        tape: dict = {}
        for s, order, side in (("f", range(SPAN), slice(0, h)), ("b", range(SPAN - 1, -1, -1), slice(h, 2 * h))):
            proj = dot(x, p["x" + s]) + p["c" + s]
            now = np.zeros((n, h), np.float32)
            u = p["u" + s]
            for t in order:
                a = proj[cell[t]]
                g = dot(now, u)
                zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
                if keep:
                    tape[s, t] = now, z, r, c, g[:, 2 * h :]
                now = now + m[t] * z * (c - now)
                states[t, :, side] = now
        pre = np.tanh(dot(states, p["att"]))
        e = np.where(mask, dot(pre, p["v"][:, None])[..., 0], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e /= sum(e)
        pooled = sum(e[t, :, None] * states[t] for t in range(SPAN))
        if keep:
            tape |= {"states": states, "pre": pre, "e": e, "pooled": pooled, "m": m}
        return dot(pooled, p["w"][:, None])[:, 0] + p["b"][0], tape

    def gradients(self, d: np.ndarray, tape: dict, x: np.ndarray, cell: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of all dense parameters, and of each distinct word's input, from d(loss)/d(logit)."""
        p, h = self.p, STATE
        states, pre, e, m = tape["states"], tape["pre"], tape["e"], tape["m"]
        dp = d[:, None] * p["w"]
        out = {"w": tape["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        da = (states * dp).sum(axis=2)
        ds = e * (da - (e * da).sum(axis=0))
        dpre = ds[..., None] * p["v"] * (1 - pre**2)
        out["v"] = (ds[..., None] * pre).sum(axis=(0, 1))
        out["att"] = np.einsum("tnh,tnk->hk", states, dpre)
        dstates = e[..., None] * dp + dpre @ p["att"].T
        dx = np.zeros_like(x)
        for s, order, side in (("f", range(SPAN - 1, -1, -1), slice(0, h)), ("b", range(SPAN), slice(h, 2 * h))):
            u, carry = p["u" + s], 0.0
            du, dproj = np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t in order:
                before, z, r, c, gc = tape[s, t]
                dh = dstates[t, :, side] + carry
                dm = dh * m[t]
                dac = dm * z * (1 - c**2)
                daz = dm * (c - before) * z * (1 - z)
                dar = dac * gc * r * (1 - r)
                dg = np.concatenate([daz, dar, dac * r], axis=1)
                carry = dh - dm * z + dg @ u.T
                du += before.T @ dg
                np.add.at(dproj, cell[t], np.concatenate([daz, dar, dac], axis=1))
            out["u" + s], out["x" + s], out["c" + s] = du, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p["x" + s].T
        return out, dx

    def train(self, w: Words, windows: tuple[np.ndarray, np.ndarray], y: np.ndarray, doc: np.ndarray, seed: int = 11) -> None:
        """Every window has its document's label at first; then each document's likeliest ones count.

        A toxic document teaches with its likeliest windows, a clean one with its likeliest and
        some others: the document's score is its largest window's.
        """
        rng = np.random.default_rng(seed)
        first, at = windows
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for phase, (epochs, rate) in enumerate(PHASES):
            easy = rng.random(len(y)) < (min(1.0, 1.5 * y.sum() / max(1, (y == 0).sum())) if phase == 0 else EASY)
            use = np.flatnonzero((y == 1) | easy)
            if phase:
                logits = self.logits(w, windows)
                order = np.lexsort((-logits, doc))
                start = np.flatnonzero(np.concatenate([[True], np.diff(doc[order]) > 0]))
                rank = np.empty(len(y), np.int64)
                rank[order] = np.arange(len(y)) - np.repeat(start, np.diff(np.concatenate([start, [len(y)]])))
                best = np.full(doc.max() + 1, -np.inf)
                np.maximum.at(best, doc, logits)
                use = np.flatnonzero(np.where(y == 1, (logits >= best[doc] - 1) | (logits > 3), (rank < HARD) | easy))
            weight = np.where(y == 1, 0.5 / max(1, (y[use] == 1).sum()), 0.5 / max(1, (y[use] == 0).sum())) * len(use)
            for _ in range(epochs):
                rng.shuffle(use)
                for a in range(0, len(use), BATCH):
                    b = use[a : a + BATCH]
                    cell, mask = w.cells(first[b], at[b])
                    ids, cell = np.unique(cell, return_inverse=True)
                    cell = cell.reshape(SPAN, len(b))
                    own = _Subset(w, ids)
                    row, x = self.inputs(own)
                    logit, tape = self.forward(x, cell, mask, keep=True)
                    d = ((_sigmoid(logit) - y[b]) * weight[b] / len(b)).astype(np.float32)
                    grad, dx = self.gradients(d, tape, x, cell)
                    grad["word"] = np.zeros_like(self.p["word"])
                    np.add.at(grad["word"], row, dx[:, :WORD_DIM])
                    per = np.repeat(dx[:, WORD_DIM:] / np.sqrt(own.sizes)[:, None], own.sizes, axis=0)
                    grad["char"] = np.column_stack([np.bincount(own.grams, weights=per[:, k], minlength=BUCKETS) for k in range(CHAR_DIM)]).astype(np.float32)
                    step += 1
                    for k, g in grad.items():
                        g = g + DECAY * self.p[k]
                        m, v = moment[k]
                        m += 0.1 * (g - m)
                        v += 0.001 * (g * g - v)
                        self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, w: Words, windows: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        first, doc = windows or w.windows()
        _, x = self.inputs(w)
        return np.concatenate([np.zeros(0), *(self.forward(x, *w.cells(first[a : a + AT_ONCE], doc[a : a + AT_ONCE]))[0] for a in range(0, len(first), AT_ONCE))])

    def documents(self, column: pa.Array) -> np.ndarray:
        """The largest window logit of each text; minus infinity without words."""
        w = Words(column)
        first, doc = w.windows()
        out = np.full(len(column), -np.inf)
        if len(first):
            np.maximum.at(out, doc, self.logits(w, (first, doc)))
        return out

    def calibrate(self, top: np.ndarray, y: np.ndarray, share: float) -> None:
        """Logistic regression of the label on a document's logit, by damped Newton steps.

        Classes are weighted so that `share` of the documents are toxic.
        """
        n = max(1, len(y))
        c = np.where(y == 1, share * n / max(1, (y == 1).sum()), (1 - share) * n / max(1, (y == 0).sum()))
        mean, std = top.mean(), max(float(top.std()), 1e-6)
        t = np.column_stack([(top - mean) / std, np.ones(len(top))])
        loss = lambda b: (c * np.logaddexp(0, np.where(y == 1, -1, 1) * (t @ b))).sum() + 0.05 * (b @ b)
        b = np.zeros(2)
        for _ in range(40):
            q = _sigmoid(t @ b)
            step = np.linalg.solve((t * (c * q * (1 - q))[:, None]).T @ t + 0.1 * np.eye(2), t.T @ (c * (q - y)) + 0.1 * b)
            size = 1.0
            while size > 1e-6 and loss(b - size * step) > loss(b):
                size /= 2
            b = b - size * step
        slope = max(float(b[0]), 1e-3) / std
        self.scale, self.shift = slope, float(b[1]) - slope * mean

    def score(self, column: pa.Array) -> np.ndarray:
        top = self.documents(column)
        return np.where(np.isfinite(top), _sigmoid(self.scale * np.where(np.isfinite(top), top, 0.0) + self.shift), 0.0)


class _Subset:
    """Some of the distinct words."""

    def __init__(self, w: Words, ids: np.ndarray) -> None:
        self.hashes, self.sizes = w.hashes[ids], w.sizes[ids]
        self.heads = np.cumsum(self.sizes) - self.sizes
        self.grams = w.grams[np.repeat(w.heads[ids] - self.heads, self.sizes) + np.arange(self.sizes.sum())]


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows of each text as texts of their own."""
    for b in batches:
        ids, ys, out = [], [], []
        for i, y, text in zip(*(b.column(k).to_pylist() for k in range(3))):
            words = bytes(LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)])
            words = bytes(32 if NOT_ALNUM[c] else c for c in words).split()
            starts = list(range(0, max(1, len(words) - STRIDE), STRIDE))
            most = TOXIC_WINDOWS if y else CLEAN_WINDOWS
            for k in range(min(most, len(starts))) if words else ():
                a = starts[k * len(starts) // min(most, len(starts))]
                ids.append(i)
                ys.append(y)
                out.append(b" ".join(words[a : a + SPAN]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(out, pa.string())], names=["doc_id", "toxic", "text"])


def _teaches(doc_id: int) -> bool:
    """Whether a document of the sample trains the net; the others calibrate it."""
    return doc_id * 2654435761 % 2**32 * CALIBRATION >> 32 != 0


def fit(docs: DataFrame, labels: DataFrame, training) -> Net | float:
    """A net from a bounded sample of the labelled rows where `training` holds.

    Where the labels have one class only, or none, the answer is that class's number (0 for none).
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(training)
    have = docs.where("text is not null").select("doc_id").distinct()
    there = known.join(have, "doc_id", "left_semi")
    # A sorted limit for each class: every task passes on its own first rows, and no class is one task's.
    first = lambda y, n: there.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(1, TOXIC_DOCS).unionByName(first(0, CLEAN_DOCS))
    label = {r.doc_id: r.toxic for r in picked.select("doc_id", "toxic").collect()}  # at most TOXIC_DOCS + CLEAN_DOCS
    if len(set(label.values())) < 2:
        return float(next(iter(label.values()), 0))
    share = known.agg(F.avg("toxic")).first()[0]
    ids = spark.createDataFrame(list(label.items()), "doc_id bigint, toxic int")
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text")
    got = sample.mapInArrow(_windows_of, "doc_id bigint, toxic int, text string").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    if not len(set(got["toxic"].to_pylist())) == 2:
        return 0.0
    teach = got.filter(pa.array([_teaches(i) for i in got["doc_id"].to_pylist()], pa.bool_()))
    if len(set(teach["toxic"].to_pylist())) < 2:
        teach = got
    w = Words(teach["text"])
    y = teach["toxic"].to_numpy().astype(np.float32)
    _, doc = np.unique(teach["doc_id"].to_numpy(), return_inverse=True)
    pairs = np.unique(np.column_stack([w.hashes[w.ids].view(np.int64), np.repeat(doc, np.diff(w.bounds))]), axis=0)[:, 0].view(np.uint64)
    often, count = np.unique(pairs, return_counts=True)
    net = Net(often[count >= WORD_DOCS])
    first, at = w.windows()
    net.train(w, (first, at), y[at], doc[at])
    shared = spark.sparkContext.broadcast(net)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.documents(b.column(2)))], names=["doc_id", "toxic", "top"])

    t = sample.mapInArrow(tops, "doc_id bigint, toxic int, top double").toArrow()
    top, y = t["top"].to_numpy(), t["toxic"].to_numpy().astype(float)
    apart = np.isfinite(top) & np.array([not _teaches(i) for i in t["doc_id"].to_pylist()])
    if len(set(y[apart])) < 2:
        apart = np.isfinite(top)
    net.calibrate(top[apart], y[apart], share)
    return net


def score(docs: DataFrame, net: Net | float) -> DataFrame:
    """The input columns plus `score`, from the text alone; 0 for a text without words, and for a null one.

    An input column `score` is replaced; rows that repeat stay rows; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "score"]
    base, at = docs.select(*kept), kept.index("text")
    if isinstance(net, float):
        return base.withColumn("score", F.lit(net))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(b.column(at)), pa.float64())], names=[*kept, "score"])

    from pyspark.sql import types as T

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's query: labels of rows whose crc32(doc_id) mod 5 is not 0 teach, all rows are scored.

    A null or empty text has score 0; repeated rows are scored alike; a label without a document, or
    with a null, is ignored, and of several labels of one id the largest counts.
    """
    out = held_out(F.col("doc_id"), 5, 0)
    net = fit(docs, labels, ~out)
    scored = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), net)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
