"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, fingerprints, jaccard, langid, shards, substrings, suffixtree, toxicity, urlfilter
from quarry.llm.queries import tokenizer_file

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran off", "en", "a", 1, 9.0),
    (2, None, "en", "a", 2, 9.0),
    (3, "", None, None, 3, 9.0),
    (4, "the cat sat on the mat and the dog ran off", "en", None, 4, 9.0),
    (4, "the cat sat on the mat and the dog ran off", "en", None, 4, 9.0),
    (5, "12 34 !!", "de", "b", 5, 9.0),
    (6, LONG, "de", "b", 6, 9.0),
    (None, "ein Hund und eine Katze", "de", "b", 7, 9.0),
    (None, None, None, None, 8, 9.0),
    (7, "퟿ \x00 \x1c é É ß 漢字", "de", "b", 7, 9.0),
]
COLUMNS = "doc_id bigint, text string, lang string, source string, batch int, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (5, 0), (99, 1), (None, 1), (6, 0), (7, 0)], "doc_id bigint, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3)} == {0.0}
    assert len({r.score for r in got if r.doc_id in (1, 4)}) == 1
    assert all(r.score == 0 for r in toxicity.toxicity(docs, labels.limit(0)).collect())
    assert rows(toxicity.toxicity(none, labels)) == []


def test_language(docs, none):
    got = langid.languages(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 5)} == {"und"}
    assert all(r.lang_pred in ("en", "de") for r in got if r.doc_id in (1, 4, 6))
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert rows(langid.languages(none)) == []


def test_urls(spark):
    t = lambda d: F.to_timestamp(F.lit(f"2021-01-{d:02d}"))
    caps = spark.createDataFrame([(1, "http://A.x.org/p/q", 5), (1, "http://A.x.org/p/q", 5), (2, "http://a.x.org/p", 15), (3, None, 5), (4, "nonsense", 5), (None, "http://u@b.org:80/", 12), (5, "http://x.org", None)], "page_id bigint, url string, d int")
    caps = caps.select("page_id", "url", F.expr("make_timestamp(2021, 1, d, 0, 0, 0)").alias("fetched_at"))
    entries = spark.createDataFrame([("x.org", 1, "block"), ("x.org", 10, "remove"), ("a.x.org/p", 14, "allow"), ("a.x.org", 14, "block"), ("b.org", 12, "block"), ("b.org", 12, "allow"), (None, 1, "block"), ("c.org", None, "block")], "key string, d int, action string")
    entries = entries.select("key", F.expr("make_timestamp(2021, 1, d, 0, 0, 0)").alias("dated"), "action")
    got = {(r.page_id, r.url): (r.blocked, r.entry) for r in urlfilter.judge(caps, entries).collect()}
    assert got[1, "http://A.x.org/p/q"] == (True, "x.org") and got[2, "http://a.x.org/p"] == (False, "a.x.org/p")
    assert got[3, None] == got[4, "nonsense"] == got[5, "http://x.org"] == (False, None)
    assert got[None, "http://u@b.org:80/"] == (True, "b.org")
    assert urlfilter.judge(caps, entries).count() == 7
    assert urlfilter.judge(caps, entries.limit(0)).where("blocked").count() == 0
    assert urlfilter.judge(caps.limit(0), entries).count() == 0


def test_urls_of_any_length(spark):
    deep, far = ".".join(f"l{i}" for i in range(12)) + ".org", "a.org/" + "/".join(f"s{i}" for i in range(9))
    caps = spark.createDataFrame([(1, f"http://{deep}/x"), (2, f"http://{far}/more?q=1"), (3, "http://a.org/s0/s1/s2/s3")], "page_id bigint, url string")
    caps = caps.withColumn("fetched_at", F.expr("make_timestamp(2021, 1, 5, 0, 0, 0)"))
    entries = spark.createDataFrame([(deep, "block"), ("org", "allow"), (far, "block"), ("a.org/s0", "allow"), ("a.org/s0/s1/s2/s3", "block")], "key string, action string")
    entries = entries.withColumn("dated", F.expr("make_timestamp(2021, 1, 1, 0, 0, 0)"))
    got = {r.page_id: (r.blocked, r.entry) for r in urlfilter.judge(caps, entries).collect()}
    assert got == {1: (True, deep), 2: (True, far), 3: (True, "a.org/s0/s1/s2/s3")}


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "The CAT, sat on\nthe mat"), (1, "dog ran"), (2, None), (3, ""), (None, "the cat"), (4, " ".join(f"w{i % 977}x{i % 31}" for i in range(13, 40)))], "item_id bigint, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate.digest(docs, bench).collect()}
    assert got[1, 11].n_hit == 8 and got[1, 11].n_items == 1 and got[1, 11].contaminated
    assert got[2, 0].n_hit == 0 and not got[3, 0].contaminated
    assert got[6, 30_000].n_hit == 27 and not got[6, 30_000].contaminated
    spans = decontaminate.contamination(docs, bench).where("doc_id = 1").first()
    assert [ROWS[0][1][s.start : s.stop] for s in spans.spans] == ["the cat sat on the mat", "dog ran"]
    small = decontaminate.contamination(docs, bench, limit=8)  # several automata
    assert sorted((r.doc_id or 0, r.n_hit, sorted(r["items"])) for r in small.collect()) == sorted((r.doc_id or 0, r.n_hit, sorted(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
    assert decontaminate.digest(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert rows(decontaminate.digest(none, bench)) == []


def test_shards(docs, none):
    got = shards.interleave(docs, slices=8).collect()
    assert len(got) == len(ROWS)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values()) and max(map(len, sizes.values())) <= 1
    assert {r.size for r in got if r.doc_id in (2, 3)} == {1} and {r.text_crc32 for r in got if r.doc_id in (2, 3)} == {0}
    assert rows(shards.interleave(none)) == []


def test_fingerprints(docs, none):
    got = fingerprints.digest(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[4].fingerprint != by[6].fingerprint
    assert by[2].fingerprint == "" and by[2].n_chars == 0 and by[3].near_edited == 1.0
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert rows(fingerprints.digest(none)) == []


def test_fingerprints_of_extreme_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_ROWS", 8)
    ids = [-(2**63), 2**63 - 1, 2**61, None, *range(100)]
    data = [(i, f"text number {k} with some more words {k * 7}") for k, i in enumerate(ids)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.digest(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()}
    order = sorted((x for x in data if x[0] is not None), reverse=True) + [(None, data[3][1])]
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]
        assert got[i] == hashlib.sha256(edited.encode()).hexdigest(), i


def test_bpe(docs, none):
    got = bpe.digest(docs, tokenizer_file()).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert rows(bpe.digest(none, tokenizer_file())) == []


def test_scoring(docs, none):
    got = suffixtree.score(docs).collect()
    assert len(got) == len(ROWS) and {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert rows(suffixtree.score(none)) == []
    alone = suffixtree.score(docs.where("doc_id = 16 or text is null")).collect()
    assert all(r.n_known <= 1 for r in alone)


def test_substrings(docs, none):
    got = {(r.doc_id, r.n_words): r for r in substrings.dedup(docs).collect()}
    assert len(substrings.dedup(docs).collect()) == len(ROWS) and got[2, 0].kept == "" and got[6, 30_000].n_removed == 0
    assert {r.doc_id: r.batch for r in substrings.dedup(docs).collect()}[6] == 6  # a column of the input stays
    assert rows(substrings.dedup(none)) == []


def test_jaccard(docs, none):
    got = jaccard.join(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.component_id for r in got if r.doc_id in (1, 4)} == {1} and {r.component_id for r in got if r.doc_id == 3} == {3}
    assert {r.n_shingles for r in got if r.doc_id in (2, 3)} == {0}
    assert rows(jaccard.join(none)) == []


def test_every_language_is_learned(spark):
    """A language whose rows are thousands of copies of few texts beside one of many texts."""
    czech = ["příliš žluťoučký kůň úpěl ďábelské ódy", "dnes je krásný den a svítí slunce", "kdo jinému jámu kopá sám do ní padá"]
    rows = [(k, czech[k % 3], "cs") for k in range(0, 9000)] + [(10_000 + k, f"the ship number {k} sails at noon with crew {k % 7}", "en") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(6)
    same = docs.withColumn("doc_id", F.when(F.col("lang") == "cs", F.lit(7).cast("bigint")).otherwise(F.col("doc_id")))
    for table in (docs, same, same.withColumn("doc_id", F.when(F.col("lang") != "cs", F.col("doc_id")))):
        model = langid.fit(table, F.lit(True))
        assert sorted(model.langs) == ["cs", "en"]
        assert model.predict(["kůň a slunce", "the crew sails"])[0] == ["cs", "en"]


def test_urls_with_clashing_columns(spark):
    t = F.expr("make_timestamp(2021, 1, 5, 0, 0, 0)")
    caps = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (2, "http://b.org")], "page_id bigint, url string").withColumn("fetched_at", t)
    entries = spark.createDataFrame([("a.org", "block")], "key string, action string").withColumn("dated", F.expr("make_timestamp(2021, 1, 1, 0, 0, 0)"))
    plain = sorted(map(str, urlfilter.judge(caps, entries).collect()))
    clash = caps
    for c in ("key", "slot", "host", "path", "action", "since", "until", "times", "e", "blocked", "entry"):
        clash = clash.withColumn(c, F.lit("clash"))
    assert sorted(map(str, urlfilter.judge(clash, entries.withColumn("slot", F.lit(1)).withColumn("page_id", F.lit(9))).collect())) == plain


def test_equal_fractions(spark):
    """Sources of one size, whose fractional ranks tie row by row, are dealt alike whatever the layout."""
    rows = [(k, "same text", f"s{k % 4}") for k in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = sorted(map(tuple, shards.interleave(df).collect()))
    assert got == sorted(map(tuple, shards.interleave(df.repartition(5)).collect()))
    for s in range(16):
        mine = [r for r in got if r[4] == s]
        assert sorted(r[5] for r in mine) == list(range(10))
        assert {src: sum(rows[r[0]][2] == src for r in mine) for src in ("s0", "s1", "s2", "s3")}.keys() == {"s0", "s1", "s2", "s3"}


def test_ties_of_the_samples(spark):
    """Rows of one id and text, more than any sample, and ids null: the models come about, the same each time."""
    docs = spark.createDataFrame([(None if k % 3 else k % 5, "one same text here", "en") for k in range(900)] + [(1000 + k, "ein anderer satz", "de") for k in range(300)], "doc_id bigint, text string, lang string").repartition(4)
    one, two = (langid.fit(docs.repartition(n), F.lit(True)) for n in (2, 5))
    assert one.langs == two.langs and (one.weights == two.weights).all()
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("toxic")).distinct()
    scores = [sorted(map(tuple, toxicity.toxicity(docs.repartition(n), labels).collect()), key=str) for n in (2, 5)]
    assert scores[0] == scores[1] and len(scores[0]) == 1200
