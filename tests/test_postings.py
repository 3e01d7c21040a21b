"""The stored keyword index against a search of every posting, and what it reads."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical, postings


@pytest.fixture(scope="module")
def corpus(spark):
    """Words of very unlike frequency, chunks of very unlike length, some without words."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    weight = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocab, weight, k=int(rng.paretovariate(0.8)) % 400 + 1))) for i in range(2500)]
    rows += [(9000, ""), (9001, None), (9002, "..."), (9003, "snake_case snake case Snake-Case"), (9004, "case snake"), (9005, "w10 " * 500)]
    return spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(8)
    rows = [(q, " ".join(f"w{min(int(9 * rng.paretovariate(0.6)), 299)}" for _ in range(rng.randrange(1, 7)))) for q in range(30)]
    rows += [(100, "snake_case"), (101, "snake_case w299 w299"), (102, "unknownword"), (103, "the of"), (104, ""), (105, None), (106, "w10 w250")]
    return spark.createDataFrame(rows, "query_id bigint, query string")


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return postings.build(corpus, str(tmp_path_factory.mktemp("index") / "k"), buckets=16)


def best(df, digits=6):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, digits)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 100])
def test_search_is_bm25(corpus, asked, index, k):
    want = lexical.top(lexical.bm25(asked, corpus).withColumn("score", F.round("score", 9)), k)
    got = postings.search(asked, index, k, digits=9)
    assert best(got) == best(want)
    assert {r.query_id for r in got.collect()}.isdisjoint({102, 103, 104, 105})


def test_filter_chooses_from_the_result(corpus, asked, index):
    ids = corpus.where("chunk_id % 7 = 3").select("chunk_id")
    want = lexical.bm25(asked, corpus).join(ids, "chunk_id", "left_semi").withColumn("score", F.round("score", 9))
    assert best(postings.search(asked, index, 5, ids, 9)) == best(lexical.top(want, 5))


def test_groups_are_passed_over(spark, asked, index):
    """Groups without the rare word cannot come up to those with it, however often they have the other."""
    one = asked.where("query_id = 106")
    found = postings.search(one, index, 1)
    assert found.count() == 1
    blocks = postings._postings(spark, index).where(F.col("term").isin("w10", "w250"))
    groups = blocks.select("grp").distinct().count()
    assert groups > 15
    opened = postings.opened(one, index, 1).count()
    assert 0 < opened <= groups // 3


def read(df):
    """(files, bytes) that the scan of a plan opened."""
    plan = df._jdf.queryExecution()
    df._jdf.collectAsList()
    metrics = plan.executedPlan().collectLeaves().head().metrics()
    return tuple(metrics.get(name).get().value() for name in ("numFiles", "filesSize"))


def test_only_buckets_of_the_words_are_listed(spark, index):
    whole = postings._postings(spark, index)
    some = postings.pruned(whole, ["w30"], index)
    assert 0 < read(some)[0] <= read(whole)[0] / 8
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and "EqualTo(term,w30)" in plan
    one = spark.createDataFrame([(1, "w30")], "query_id bigint, query string")
    plan = postings.search(one, index)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "/postings]" in x]
    assert scans and all(re.search(r"PartitionFilters: \[.*bucket", x) for x in scans)


def test_bytes_read_follow_the_words(spark, index):
    whole = postings._postings(spark, index)
    size = lambda words: read(postings.pruned(whole, words, index))[1]
    assert size(["w30"]) < size([f"w{i}" for i in range(30, 34)]) < size([f"w{i}" for i in range(30, 90)]) <= read(whole)[1]


def test_flat_is_what_was_written(corpus, spark, index):
    rows = lambda df: sorted((r.term, r.chunk_id, r.tf, tuple(r.positions)) for r in df.collect())
    assert rows(postings.flat(spark, index)) == rows(lexical.postings(corpus))


def shuffled(spark, f):
    """Bytes that the stages of f() hand to an exchange."""
    sc = spark.sparkContext
    gateway, store = sc._gateway, sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    last = max((s.stageId() for s in (it.apply(i) for it in [stages()] for i in range(it.size()))), default=-1)
    f()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() for s in (it.apply(i) for it in [stages()] for i in range(it.size())) if s.stageId() > last)


def test_little_is_shuffled(spark, tmp_path):
    """A build hands on its texts' postings in less than the texts have, a search of many frequent words much less than these."""
    rng = random.Random(4)
    vocab = [f"w{rng.randrange(10**6)}" for _ in range(20000)]
    weight = [1 / (i + 1) for i in range(20000)]
    rows = [(i, " ".join(rng.choices(vocab, weight, k=150))) for i in range(3000)]
    corpus = spark.createDataFrame(rows, "chunk_id bigint, text string").repartition(2).localCheckpoint()
    asked = spark.createDataFrame([(q, " ".join(vocab[:50])) for q in range(40)], "query_id bigint, query string")
    size = sum(len(t) for _, t in rows)
    index = []
    assert shuffled(spark, lambda: index.append(postings.build(corpus, str(tmp_path / "k"), buckets=4))) < size
    found = postings.search(asked, index[0], 10)
    assert shuffled(spark, lambda: found.count()) < size
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)


def test_empty_index(spark, asked, tmp_path):
    none = spark.createDataFrame([], "chunk_id bigint, text string")
    index = postings.build(none, str(tmp_path / "k"))
    assert postings.search(asked, index).collect() == []


def test_numbers_of_few_bytes():
    rng = np.random.default_rng(5)
    for n in (np.zeros(0, np.int64), np.array([0, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32, 0]), rng.integers(0, 2**20, 999)):
        raw, many = postings._packed(n)
        assert many.sum() == len(raw) and postings._unpacked(raw).tolist() == n.tolist()
    many = np.array([0, 3, 0, 0, 1, 2, 0])
    values = np.array([4, 9, 9, 7, 0, 5])
    assert postings._summed(postings._since(values, np.array([0, 3, 4])), many).tolist() == values.tolist()


@pytest.mark.parametrize("written", [False, True])
def test_many_runs_and_blocks_of_queries(spark, corpus, asked, tmp_path, monkeypatch, written):
    """Chunks of many runs, queries of many blocks, phrases whose words repeat, ids that are words; built from texts or from postings."""
    monkeypatch.setattr(postings, "RUN", 150)
    monkeypatch.setattr(postings, "QUERIES", 7)
    odd = ["go_go go", "go go_go go go_stop", "stop_go", "go stop go " * 90, "go"]
    rows = spark.createDataFrame([(20000 + i, t) for i, t in enumerate(odd)], "chunk_id bigint, text string")
    corpus = corpus.unionByName(rows).localCheckpoint()
    more = spark.createDataFrame([("a", "go_go"), ("b", "go_go stop_go go_stop"), ("c", "go_go_go w30")], "query_id string, query string")
    asked = asked.withColumn("query_id", F.col("query_id").cast("string")).unionByName(more).localCheckpoint()
    if written:
        index = postings.write(lexical.postings(corpus), lexical.lengths(corpus), str(tmp_path / "k"), 3)
    else:
        index = postings.build(corpus, str(tmp_path / "k"), buckets=3)
    placed = postings._placed(spark, index)
    assert placed.select("run").distinct().count() > 15 and placed.count() == corpus.count() == placed.select("run", "place").distinct().count()
    want = lexical.top(lexical.bm25(asked, corpus).withColumn("score", F.round("score", 9)), 20)
    assert best(postings.search(asked, index, 20, digits=9)) == best(want)


@pytest.mark.parametrize("blocks", [dict(chunks=97), dict(chunks=5000)])
def test_blocks_find_what_bm25_finds(corpus, asked, blocks, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 7)
    index = lexical.prepared(corpus)
    for k in (1, 10, 5000):
        want = lexical.top(lexical.bm25(asked, corpus).withColumn("score", F.round("score", 9)), k)
        assert best(lexical.best(asked, index, k, 9, **blocks)) == best(want)


def test_no_pair_of_query_and_chunk_is_shuffled(corpus, asked):
    """Rows that leave the exchanges: a posting of a query's word at most once, and each cell's best."""
    found = lexical.best(asked, lexical.prepared(corpus), 3, 9)
    found._jdf.collectAsList()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, chunk_id", plan)


def test_postings_fold_words_and_are_not_shuffled(spark):
    texts = ["Été ETE été x", "", None, "ß İx ǅ 12", "été"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    have = lexical.postings(df)
    assert "Exchange" not in have._jdf.queryExecution().executedPlan().toString()
    words = df.select("chunk_id", F.posexplode(lexical.tokens(F.col("text"))).alias("pos", "term")).collect()
    want = {}
    for r in words:
        want.setdefault((r.term, r.chunk_id), []).append(r.pos)
    assert {(r.term, r.chunk_id): r.positions for r in have.collect()} == want
    assert {r.chunk_id: r.dl for r in lexical.lengths(df).collect()} == {i: sum(x.chunk_id == i for x in words) for i in range(5)}


def test_best_reads_a_text_once(spark):
    """Postings, lengths and counts come from one pass over the texts; no place is null, and runs still have theirs."""
    texts = ["new_york is big", "York new, new york", "", None, "ÉCOLE new", "--- new_york new_york"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    seen = []

    def keep(once):
        seen.append((once._jdf.queryExecution().executedPlan().toString().count("MapInArrow"), {(r.chunk_id, r.term): (r.tf, r.positions) for r in once.collect()}))
        return once

    for query, places in (("new_york ecole", True), ("ecole york", False)):
        asked = spark.createDataFrame([(1, query)], "query_id bigint, query string")
        got = {r.chunk_id: round(r.score, 9) for r in lexical.best(asked, lexical.prepared(df), 9, 9, keep=keep).collect()}
        assert got == {r.chunk_id: round(r.score, 9) for r in lexical.bm25(asked, df).collect() if r.score > 0}
        scans, rows = seen[-1]
        assert scans == 1 and all(p is not None for _, p in rows.values())
        assert {c: n for (c, t), (n, _) in rows.items() if t is None} == {0: 4, 1: 4, 2: 0, 3: 0, 4: 2, 5: 4}
        assert rows[1, "york"] == (2, [0, 3] if places else []) and rows[4, "ecole"] == (1, [])


def test_only_words_asked_for_leave_the_texts(spark, monkeypatch):
    """Words of the queries are sent to where texts are read; no join meets every posting but with too many words to send."""
    texts = ["new_york is big", "York new, new york" + " other words" * 40, "", None, "École, NEW", "--- new_york new_york"]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, text string")
    asked = spark.createDataFrame([(1, "new_york ecole"), (2, "york big is"), (3, "- 7"), (4, None)], "query_id bigint, query string")
    want = sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in lexical.bm25(asked, df).collect())
    seen = []

    def keep(once):
        rows = sorted((r.chunk_id, r.term or "", r.tf, r.positions) for r in once.collect())
        seen.append(("Join" in once._jdf.queryExecution().executedPlan().toString(), rows))
        return once

    for sent in (1 << 17, 2):
        monkeypatch.setattr(lexical, "SENT", sent)
        got = lexical.best(asked, lexical.prepared(df), 9, 9, keep=keep).collect()
        assert sorted((r.query_id, r.chunk_id, r.score) for r in got) == want
    assert [joined for joined, _ in seen] == [False, True] and seen[0][1] == seen[1][1]
    out = lexical._read(df, "text", True, False, {"york": True, "new": False})
    assert sorted((r.term, r.chunk_id, r.tf, r.positions) for r in out.collect()) == [
        ("new", 0, 1, []), ("new", 1, 2, []), ("new", 4, 1, []), ("new", 5, 2, []),
        ("york", 0, 1, [1]), ("york", 1, 2, [0, 3]), ("york", 5, 2, [1, 3]),
    ]
    assert lexical._read(df, "text", True, False, {}).count() == 0


def test_words_of_odd_texts(spark):
    """Separators and letters within ASCII and beyond it are those of `tokens`, whatever a batch's other texts are."""
    odd = ["".join(map(chr, range(1, 128))), "ΟΔΟΣ ΣΑΣ", "KELVIN K x y z", "𝔘x 𐐀b \U0001f600c 1٠½Ⅷ", "İ i̇ é", "日本語 ſ ﬁ Ạ\u200bb", "naïve—Café_ÜBER", "\x00a\x7fB\ufffdİ"]
    texts = [t for i in range(170) for t in (odd[i % 8], "", f"Plain_{i} x", None)]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string").repartition(1)
    want = {}
    for r in df.select("chunk_id", F.posexplode(lexical.tokens(F.col("text"))).alias("pos", "term")).collect():
        want.setdefault((r.term, r.chunk_id), []).append(r.pos)
    assert {(r.term, r.chunk_id): r.positions for r in lexical.postings(df).collect()} == want
    asked = {t: True for t, _ in want}
    assert {(r.term, r.chunk_id): r.positions for r in lexical._read(df, asked=asked).collect()} == want
    size = {r.chunk_id: r.dl for r in lexical.lengths(df).collect()}
    assert {r.chunk_id: r.tf for r in lexical._read(df, "text", False, True, {}).collect()} == size


@pytest.mark.parametrize("cell", [1, 50, 1 << 22])
def test_a_cell_adds_what_is_there(cell, monkeypatch):
    monkeypatch.setattr(lexical, "CELL", cell)
    rng = np.random.default_rng(3)
    asked = pa.table({"query_id": [9, 9, 4, 4, 7], "words": [["a"], ["b"], ["b"], ["c"], ["d"]], "weight": [1.0, 2.0, 0.5, 3.0, 1.0], "avgdl": [6.0] * 5})
    rows = [(i, t, int(rng.integers(1, 5))) for i in range(40) for t in "abce" if rng.random() < 0.5] + [(i, None, int(rng.integers(4, 9))) for i in range(40)]
    held = pa.table({"chunk_id": [r[0] for r in rows], "term": [r[1] for r in rows], "tf": pa.array([r[2] for r in rows], pa.int32())})
    dl = {c: n for c, t, n in rows if t is None}
    want = {}
    for q, (t,), w in zip(*(asked[c].to_pylist() for c in ("query_id", "words", "weight"))):
        for c, u, n in rows:
            if u == t:
                want[q, c] = want.get((q, c), 0) + w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl[c] / 6))
    found = lexical._cell(asked, held, 40, 9).to_pylist()
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in found} == {k: round(v, 9) for k, v in want.items()} and len(found) == len(want)
