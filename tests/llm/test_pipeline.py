"""The pipeline's stages against brute force on a small folder of tables."""

import random

import corpus_pipeline
from quarry.llm import langid

from .test_brute import brute_components, words


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    vocab = [a + b for a in ("the", "an", "ing", "or", "st", "re") for b in ("ed", "er", "ly", "es", "th", "on", "at")]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, asked, base = make(50), make(20), make(120)
    texts = [make(rng.randrange(30, 90)) for _ in range(40)]
    for k in (4, 9, 14):
        texts[k][10:10] = shared
    texts[20][5:5] = asked
    for k in (30, 31, 32):
        texts[k] = list(base)
        texts[k][k - 25] = "changed"
    rows = [(k, " ".join(t), "en" if k % 4 else "de", f"s{k % 3}", 0) for k, t in enumerate(texts)] + [(90, "12 !!", "en", "s", 5), (91, None, None, None, None), (92, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(asked).upper())], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "substring_dedup", "decontamination", "bpe"]
    step = [docs]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, step[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        step.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if k < 4:
            assert step[-1].columns == list(corpus_pipeline.COLUMNS)
    text = [{r.doc_id: r.text for r in s.select("doc_id", "text").collect()} for s in step[:5]]
    assert set(text[0]) - set(text[1]) == {90, 91, 92}
    groups = brute_components([(i, t) for i, t in text[1].items()], 5, 80, 100)
    assert set(text[2]) == {i for i, (_, c) in groups.items() if c == i} and not {31, 32} & set(text[2])
    seen = set()
    for i in sorted(text[2]):
        w, gone = words(text[2][i]), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else text[2][i]
        assert text[3].get(i) == (want or None), i
    assert set(text[3]) - set(text[4]) == {20}
    assert {r.doc_id for r in step[5].collect()} == set(text[4])
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, step[5].collect()))
    assert langid.UND == "und"


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_decide_by_row(spark, tmp_path):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))
    asked = make(20)
    spark.createDataFrame([(1, asked)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = lambda i, t: (i, t, "en", "s", 1)
    fine = [row(None, make(40)), row(None, make(40)), row(7, make(40)), row(8, make(40)), row(8, None)]
    docs = spark.createDataFrame([*fine, row(None, asked), row(7, f"x {asked}")], DOCS)
    assert sorted(map(str, corpus_pipeline.decontaminated(spark, docs, str(tmp_path)).collect())) == sorted(map(str, spark.createDataFrame(fine, DOCS).collect()))

    a, b, c, d, e = (make(60) for _ in range(5))
    docs = spark.createDataFrame([row(5, a), row(5, a), row(5, a), row(3, b), row(5, b), row(None, c), row(None, c), row(None, d), row(9, d), row(5, e), row(6, ""), row(6, "")], DOCS)
    got = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect())
    assert got == sorted([("5", a), ("3", b), ("None", c), ("9", d), ("5", e), ("6", ""), ("6", "")])


def test_documents_stay_without_a_language_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", None, "s", 1), (2, "漢字", None, "s", 1), (3, "12 !!", None, "s", 1), (4, None, None, "s", 1)], DOCS)
    assert {r.doc_id for r in corpus_pipeline.identify(spark, docs, str(tmp_path)).collect()} == {1, 2}
