"""Operators against brute force, held-out accuracy or their own laws."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, fingerprints, jaccard, langid, shards, substrings, suffixtree, toxicity
from quarry.llm.components import components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(t, low=False):
    return SPACE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}) if low else t or "")


@pytest.fixture(scope="module")
def corpus():
    """Texts that share passages, near copies in groups, copies, odd white space."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [make(rng.randrange(18, 60)) for _ in range(6)]
    out = []
    for _ in range(60):
        t = make(rng.randrange(0, 120))
        if rng.random() < 0.4:
            k = rng.randrange(len(t) + 1)
            t[k:k] = rng.choice(passages)
        out.append(t)
    base = make(150)
    for _ in range(40):  # near copies
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        out.append(t)
    out += [list(out[k]) for k in (3, 3, 5, 70)]
    out.append(["again"] * 70)
    texts = [rng.choice([" ", "\n", " \t"]).join(t) for t in out]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def test_substrings(spark, corpus):
    seen, want = set(), {}
    for i, t in sorted(corpus):
        w = words(t)
        gone = set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone |= set(range(k, k + 20))
            seen.add(key)
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    assert any(n for _, n, _ in want.values())
    for size in (2000, 1 << 22):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(frame(spark, corpus), digest=True, batch_bytes=size).collect()}
        assert got == want
    whole = substrings.dedup(frame(spark, corpus).withColumn("kept", F.lit(1)), batch_bytes=3000).collect()
    for r in whole:
        assert hashlib.sha256(r.kept.encode()).hexdigest() == want[r.doc_id][2] and sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed


def test_copies_of_a_text_ask_for_no_windows(spark):
    """A text that an earlier row has in full loses all its words, and sends neither anchors nor windows."""
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(99)) for _ in range(n))
    one, two, short = make(200), make(150), make(19)
    rows = [(i, one) for i in (5, 3, 3, None, 9)] + [(i, two) for i in (7, 1)] + [(i, short) for i in (2, 4)] + [(8, f"{make(30)} {one}"), (0, make(90))]
    for size in (300, 1 << 22):
        got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_words, r.n_removed) for r in substrings.dedup(frame(spark, rows), digest=True, batch_bytes=size).collect())
        assert got == [(0, 90, 0), (1, 150, 0), (2, 19, 0), (3, 200, 0), (3, 200, 200), (4, 19, 0), (5, 200, 200), (7, 150, 150), (8, 230, 200), (9, 200, 200), (99, 200, 200)]
    t = pa.table({"doc_id": [1, 2, 3], "_tie": [b"a", b"b", b"c"], "text": [one, one, two]})
    none = pa.table({"phase": pa.array([], pa.int32()), "same": pa.array([], pa.binary())})
    told = pa.table({"phase": pa.array([0], pa.int32()), "same": pa.array([substrings._same(two.encode())], pa.binary())})
    for heard, texts in ((none, (one, two)), (told, (one,))):
        b = substrings._Batch(t, 20, heard)
        assert set(b.row[b.anchor_at]) == ({0, 2} if len(texts) == 2 else {0})
        b.candidates(b.anchors)
        assert set(b.row[b.at]) == set(b.row[b.anchor_at])


def brute_components(rows, size, num, den):
    sets = {}
    for i, t in rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,num,tile,batch", [(3, 90, 2048, 1 << 22), (3, 90, 6, 3000), (5, 80, 8, 5000)])
def test_jaccard(spark, corpus, size, num, tile, batch):
    want = brute_components(corpus, size, num, 100)
    assert len({c for _, c in want.values()}) < len(want) - 20
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, corpus), size, num, 100, batch_bytes=batch, tile=tile).collect()}
    assert got == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {n: find(n) for n in nodes}


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = ["alpha", "beta", "Gamma", "dé", "e5", "Ünder"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(rng.randrange(1, 30))) for k in range(12)]
    docs = [(k, text(rng.randrange(0, 40)) + rng.choice(items)[1] + text(5)) for k in range(60)]
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    got = {r.doc_id: r for r in decontaminate.digest(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for i, t in docs:
        w, hit, found = low(t), set(), set()
        for k, item in items:
            v = low(item)
            n = min(13, len(v))
            for a in {tuple(v[x : x + n]) for x in range(len(v) - n + 1)}:
                for x in range(len(w) - n + 1):
                    if tuple(w[x : x + n]) == a:
                        hit |= set(range(x, x + n))
                        found.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_fingerprints(spark, corpus):
    rows = sorted(corpus, reverse=True) + [(-5, "é🙂x yz")]
    got = {r.doc_id: r for r in fingerprints.digest(frame(spark, rows)).collect()}
    sh = lambda t: {tuple(words(t.lower())[k : k + 5]) for k in range(max(1, len(words(t)) - 4))} if words(t) else set()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest(), i
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - like(sh(t), sh(edited))) < 0.15 and abs(r.near_next - like(sh(t), sh(nxt))) < 0.15
    parts = frame(spark, [(1, " ".join(f"a{i}" for i in range(900))), (1, " ".join(f"a{i}" for i in range(500, 1600)))])
    s = fingerprints.with_sketch(parts, "text", "sketch")
    one = fingerprints.merge_parts(s, ["doc_id"]).withColumn("n", fingerprints.distinct_count(F.col("sketch"))).first()
    assert abs(one.n - 1592) < 300 and len(one.sketch) == fingerprints.KEEP
    back = s.select(fingerprints.parsed(fingerprints.printed(F.col("sketch"))).alias("p"), "sketch").first()
    assert back.p == back.sketch


def test_shards(spark):
    rng = random.Random(9)
    rows = [(k, "x" * (k % 7), "big" if k % 3 == 0 else f"s{rng.randrange(9)}") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in shards.interleave(df, slices=16).collect()}
    again = {r.doc_id: r for r in shards.interleave(df.repartition(7), slices=64).collect()}
    assert got == again  # slices and layout do not matter
    for s in range(16):
        mine = [r for r in got.values() if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine))) and len(mine) in (31, 32)
        big = sum(rows[r.doc_id][2] == "big" for r in mine)
        assert abs(big - len(mine) * 167 / 500) <= 2
    assert all(r.size == r.doc_id % 7 + 1 and r.text_crc32 == zlib.crc32(b"x" * (r.doc_id % 7)) for r in got.values())


def brute_tree(train, order):
    """P(symbol | before) of the suffix tree that `train`, lists of symbols, give; None is the end."""
    count = Counter(x for t in train for x in t)
    n, v = sum(count.values()), len(count)
    follow = {}
    for t in train:
        padded = [None] * order + t
        for i, x in enumerate(t):
            for k in range(1, order + 1):
                follow.setdefault(tuple(padded[i + order - k : i + order]), Counter())[x] += 1
    nodes = set()

    def p(x, before):
        for k in range(len(before)):
            own = follow.get(before[k:])
            if own is not None and before[k:] in nodes:
                total = sum(own.values())
                return (max(own[x] - suffixtree.DISCOUNT, 0) + suffixtree.DISCOUNT * len(own) * p(x, before[k + 1 :])) / total
        return (count[x] + 1) / (n + v + 1)

    for c in sorted(follow, key=len):  # a node's test looks at shorter contexts only
        own, total = follow[c], sum(follow[c].values())
        if total >= suffixtree.LEAST:
            code = {x: min(255, round(-suffixtree.PARTS * math.log(p(x, c[1:])))) for x in own}
            gain = sum(m * (math.log(m / total) + code[x] / suffixtree.PARTS) for x, m in own.items())
            if gain >= suffixtree.GAIN * len(own):
                nodes.add(c)
    return p, count, n, v, nodes


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scoring(spark, corpus, order):
    symbols = {i: [*words(t, True), None] for i, t in corpus}
    train = [s for i, s in symbols.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    p, count, n, v, nodes = brute_tree(train, order)
    assert all(any(len(c) == k for c in nodes) for k in range(1, order + 1))
    got = {r.doc_id: r for r in suffixtree.score(frame(spark, corpus), order=order, batch_bytes=3000).collect()}
    for i, s in symbols.items():
        padded = [None] * order + s
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(s), sum(count[x] > 0 for x in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in s))
        assert r.score == pytest.approx(sum(math.log10(p(x, tuple(padded[k : k + order]))) for k, x in enumerate(s)))


def test_symbols_that_nearly_collide():
    """Successors of one context that share their lowest 24 bits and their code are told apart."""
    n = 3000
    low = np.arange(n, dtype=np.uint64) << np.uint64(24) | np.uint64(5)
    head = np.array([1, n], np.int64).tobytes() + suffixtree._planes(np.array([77]), 8) + suffixtree._planes(np.array([n]), 4)
    cell = head + suffixtree._planes(low, suffixtree.APART) + suffixtree._planes(np.full(n, 40), 1) + suffixtree._planes(np.arange(n) + 1, 4)
    for out in suffixtree._nodes([cell, cell], [0, 1]):
        assert suffixtree._whole(out, 6, 1, 6)[0] in (0, n)
        assert (suffixtree._whole(out, 12, n, 6).astype(int) == 2 * (np.arange(n) + 1)).all()


def test_tree_sends_little(spark, corpus):
    """An answer crosses the shuffle once, words are named by small numbers, and cells and texts are compressed."""
    plan = suffixtree.score(frame(spark, corpus), batch_bytes=3000)._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" :+-") for x in plan.splitlines()]
    below = [next(y for y in lines[i + 1 :] if not y.startswith("Project")) for i, x in enumerate(lines) if x.startswith("Exchange")]
    assert any(x.startswith("Union") for x in lines) and not any(x.startswith("Union") for x in below)
    words, count = np.sort(np.random.default_rng(3).integers(1 << 63, size=1000).astype(np.uint64)), np.arange(1000) % 7
    for cell in suffixtree._counts([suffixtree._planes(words, 8) + suffixtree._planes(count, 4)] * 2, [0, 1]):
        place = suffixtree._whole(cell, 6000, 1000, suffixtree.APART).astype(int)
        assert sorted(place) == list(range(1000)) and (np.diff(count[np.argsort(place)]) <= 0).all()
    texts = [None, "", "\u00e9 \U0001F600", "word " * 1000]
    rows = pa.record_batch({"doc_id": pa.array(range(4)), "text": pa.array(texts)})
    packed = pa.Table.from_batches(suffixtree._packed_texts([rows]))
    assert suffixtree._texts(packed["text"]).to_pylist() == [x or "" for x in texts] and packed["text"].nbytes < 200


def test_tree_is_a_distribution():
    rng = random.Random(11)
    train = [[*(rng.choice(["the", "then", "hen", "ab"]) for _ in range(30)), None] for _ in range(40)]
    p, count, _, _, nodes = brute_tree(train, 2)
    for before in [(None, None), ("the", "then"), ("zz", "ab"), ("ab", "zz"), *list(nodes)[:20]]:
        assert sum(p(x, before) for x in [*count, "unknown"]) == pytest.approx(1)


def test_language_accuracy(spark):
    rng = random.Random(12)
    stems = {"en": ["the", "ing", "th", "and", "er"], "de": ["sch", "ung", "der", "ein", "ß"], "es": ["ción", "los", "ado", "que", "ñ"]}
    rows = [(k, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang) for k, lang in enumerate(rng.choice(list(stems)) for _ in range(240))]
    got = langid.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("held_out").collect()
    assert len(got) > 40 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.98 * len(got)


def test_language_accuracy_in_four_scripts(spark):
    rng = random.Random(14)
    scripts = {"zh": (0x4E00, 400), "ko": (0xAC00, 300), "am": (0x1200, 60), "ru": (0x430, 32)}
    rows = [(k, "".join(chr(scripts[lang][0] + min(rng.randrange(scripts[lang][1]), rng.randrange(scripts[lang][1]))) + rng.choice(["", " "]) for _ in range(rng.randrange(8, 60))), lang) for k, lang in enumerate(rng.choice(list(scripts)) for _ in range(300))]
    got = langid.languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("held_out").collect()
    assert len(got) > 60 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 0.98 * len(got)


def test_kernel_and_ridge_by_definition():
    import numpy as np

    rng = random.Random(15)
    texts = ["".join(rng.choice("abcdeàß ,.") for _ in range(rng.randrange(5, 80))) + "x" for _ in range(40)]
    rows = [(rng.choice(["en", "fr"]), t) for t in texts]
    sets = []
    for _, t in rows:
        s = " " + re.sub(r"[^a-zàß]+", " ", t.lower()) + " "
        s = re.sub(" +", " ", s)
        sets.append({s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)})
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    for (_, t), s in zip(rows, sets):
        assert len(langid.ngrams(t)) == len(s)
    model = langid.Model(["en", "fr"], [(lang, langid.ngrams(t)) for lang, t in rows])
    # All texts are landmarks: the Nystroem kernel is the kernel, and ridge regression has its dual form.
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == x else -1.0 for x in ("en", "fr")] for lang, _ in rows])
    want = k @ np.linalg.solve(k + langid.RIDGE * len(rows) * np.eye(len(rows)), y)
    got = model._product([langid.ngrams(t) for t in texts], model.weights)
    assert np.allclose(got, want, atol=2e-2)


def test_toxic_accuracy(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["th", "en", "or", "at", "ing"]) for _ in range(rng.randrange(1, 5)))
    rows, labels = [], []
    for k in range(500):
        w = [word() for _ in range(rng.randrange(10, 90))]
        y = int(k % 4 == 0)
        if y:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["zorgle", "blat" + word()])
        rows.append((k, " ".join(w)))
        labels.append((k, y))
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("held_out").collect()
    assert len(got) > 60 and sum(r.predicted == labels[r.doc_id][1] for r in got) >= 0.93 * len(got)


def test_net_gradients():
    import numpy as np
    import pyarrow as pa

    w = toxicity.Words(pa.array(["the cat sat on a mat while dogs ran", "one two", "a b c d e f g h i j k l m n o p q r s t"]))
    net = toxicity.Net(np.unique(w.hashes)[:3])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    cell, mask = w.cells(*w.windows())
    _, x = net.inputs(w)
    x = x.astype(np.float64)
    f = lambda: net.forward(x, cell, mask)[0].sum()
    _, tape = net.forward(x, cell, mask, keep=True)
    grad, dx = net.gradients(np.ones(cell.shape[1]), tape, x, cell)
    for a, g in [(net.p[k], grad[k]) for k in ("w", "v", "att", "uf", "ub", "xf", "xb")] + [(x, dx)]:
        i = tuple(1 for _ in a.shape)
        a[i] += 1e-4
        up = f()
        a[i] -= 2e-4
        down = f()
        a[i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(g[i], abs=2e-3)


def scalar_logit(p, words, vectors):
    """The network over one window, a number at a time: gates, candidate, attention, pooling."""
    h = toxicity.STATE
    sig = lambda a: 1 / (1 + math.exp(-a))
    dot = lambda x, m, j: sum(float(a) * float(m[i][j]) for i, a in enumerate(x))
    states = [[0.0] * (2 * h) for _ in words]
    for side, order, at in (("f", range(len(words)), 0), ("b", range(len(words) - 1, -1, -1), h)):
        x, u, c = p["x" + side], p["u" + side], p["c" + side]
        now = [0.0] * h
        for t in order:
            a = [dot(vectors[words[t]], x, j) + float(c[j]) for j in range(3 * h)]
            g = [dot(now, u, j) for j in range(3 * h)]
            new = []
            for j in range(h):
                z, r = sig(a[j] + g[j]), sig(a[h + j] + g[h + j])
                cand = math.tanh(a[2 * h + j] + r * g[2 * h + j])
                new.append((1 - z) * now[j] + z * cand)
            now = new
            states[t][at : at + h] = now
    e = [math.exp(sum(math.tanh(dot(s, p["att"], k)) * float(p["v"][k]) for k in range(toxicity.ATTEND))) for s in states]
    pooled = [sum(a * s[j] for a, s in zip(e, states)) / sum(e) for j in range(2 * h)]
    return sum(a * float(b) for a, b in zip(pooled, p["w"])) + float(p["b"][0])


def test_network_number_by_number():
    import pyarrow as pa

    rng = random.Random(21)
    texts = [" ".join(rng.choice(["bad", "good", "ship", "über", "a1", "the"]) for _ in range(n)) for n in (1, 3, 16, 17, 40)]
    w = toxicity.Words(pa.array(texts))
    net = toxicity.Net(np.unique(w.hashes)[:4])
    first, doc = w.windows()
    cell, mask = w.cells(first, doc)
    _, x = net.inputs(w)
    got = net.forward(x, cell, mask)[0]
    for k in range(len(first)):
        own = cell[:, k][mask[:, k]].tolist()
        assert got[k] == pytest.approx(scalar_logit(net.p, own, x), abs=1e-4)
    n = [len(t.split()) for t in texts]
    assert sorted(set(doc.tolist())) == list(range(len(texts)))
    covered = {(int(d), int(f) - int(w.bounds[d]) + j) for f, d in zip(first, doc) for j in range(toxicity.SPAN) if f + j < w.bounds[d + 1]}
    assert covered == {(d, i) for d, m in enumerate(n) for i in range(m)}  # every word lies in a window


def test_sketch_is_the_smallest_hashes(spark):
    """All 256 hashes of a sketch, worked out again with the xxhash library."""
    import struct

    import xxhash

    def chained(numbers):
        seed = 42
        for x in numbers:
            seed = xxhash.xxh64(struct.pack("<Q", x), seed=seed).intdigest()
        return seed

    rng = random.Random(17)
    texts = [" ".join(f"W{rng.randrange(900)}é" for _ in range(n)) for n in (0, 1, 4, 5, 6, 200, 700, 3000)] + ["same " * 50, None, " \t\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fingerprints.with_sketch(df, "text", "sketch").collect():
        own = [xxhash.xxh64(x.lower().encode(), seed=42).intdigest() for x in words(texts[r.doc_id])]
        shingles = [own[i : i + 5] for i in range(len(own) - 4)] or ([own] if own else [])
        assert r.sketch == sorted({chained(s) >> 16 for s in shingles})[:256]
