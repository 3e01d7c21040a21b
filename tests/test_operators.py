"""Operators against brute force and on their odd cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.functions import classify, text
from quarry.operators import chunks, evaluate, fusion, lexical, refresh, rerank, symbols, vectors


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_text(spark):
    assert one(spark, "HTTPServer_v2", text.humanise) == "HTTP Server v 2"
    assert one(spark, "how does decryptVault work", text.query_terms) == ["decryptvault", "decrypt", "vault"]
    assert one(spark, "go_fast go_fast réponse", text.query_terms) == ["go_fast", "fast", "go_fast", "ponse"]
    assert one(spark, "HandlerStack", text.split_identifier) == ["handlerstack", "handler", "stack"]
    assert [one(spark, p, text.path_stem) for p in ("a/.bashrc", "x.tar.gz", "b/c", "Makefile")] == [".bashrc", "x.tar", "c", "Makefile"]
    assert [one(spark, q, text.is_symbol_query) for q in ("a::b", "_x", "Foo", "foo", "snake_case", "two words", "Foo\n")] == [True, True, True, False, True, False, True]
    assert one(spark, "Réf ÀÉ", text.folded) == "ref ae"
    for glob, hit, miss in (("src/*", "src/a/b", "lib/a"), ("[ab]?", "ax", "cx"), ("[^a]*", "bcd", "abc"), ("a.b", "a.b", "axb")):
        assert one(spark, hit, lambda c: text.glob_match(c, glob)) and not one(spark, miss, lambda c: text.glob_match(c, glob))
    assert one(spark, "x camelCase y", text.split_inline) == "x camelCase camel Case y"
    assert one(spark, "camelCase", text.split_appended) == "camelCase\ncamel case"


def test_classify(spark):
    yes = ("tests/a.py", "test_a.py", "a.spec.ts", "FooTests.swift", "x/__tests__/y.js", "testing/a")
    no = ("latest.py", "attestation.go", "inspection.rs", "contest/a.py")
    assert all(one(spark, p, classify.is_test) for p in yes) and not any(one(spark, p, classify.is_test) for p in no)
    files = spark.createDataFrame([("a/.bashrc",), ("x.tar.gz",), ("go.mod",), ("q.py",), ("BUILD",)], "path string")
    assert {r.path: r.lang for r in classify.with_language(files).collect()} == {"a/.bashrc": None, "x.tar.gz": None, "go.mod": "gomod", "q.py": "python", "BUILD": "starlark"}
    assert round(one(spark, "compat/test_x.py", classify.path_penalty), 6) == 0.09
    assert classify.content_scope(["all"]) == ["code", "config", "docs", "tests"] and classify.content_scope([]) == ["code", "tests", "docs", "config"]
    with pytest.raises(ValueError):
        classify.content_scope(["nope"])
    assert one(spark, "x" * 20_000, classify.looks_generated) and not one(spark, ("ab\n" * 9000), classify.looks_generated)


def test_generated_probe_keeps_long_texts(spark, tmp_path):
    from quarry.plans import queries

    line, long = "a line\n", "y" * 2000 + "\n"
    texts = [line * 12_000, long * 60, "é" * 40_000, line * 9363 + long * 9000, long * 33 + line * 200_000, "short", None]
    want = []
    for t in texts:
        data = (t or "").encode()
        sizes = sorted(map(len, data[:65_536].split(b"\n")[:-1]))
        want.append(len(data) >= 16_384 and (len(sizes) < 3 or sizes[len(sizes) // 2] > 1000))
    assert sum(len((t or "").encode()) > 65_536 for t in texts) == 5 and want == [False, True, True, False, True, False, False]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.generated for r in queries.generated_probe(spark, str(tmp_path)).collect()} == dict(enumerate(want))
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert dict(db.execute(queries.SQL["generated_probe"]).fetchall()) == dict(enumerate(want))


def greedy(rows, limit, decay):
    rows = sorted(rows, key=lambda r: (-r[3], r[0]))
    files, texts, out, floor = {}, {}, [], math.inf
    for i, path, body, base in rows:
        if len(out) >= limit and base <= floor:
            break
        n = files.get(path, 0) + (texts.get(body, 0) if body else 0)
        out.append((base * decay**n, i))
        files[path] = files.get(path, 0) + 1
        if body:
            texts[body] = texts.get(body, 0) + 1
        if len(out) >= limit:
            floor = min(e for e, _ in out)
    return [i for _, i in sorted(out, key=lambda t: (-t[0], t[1]))[:limit]]


def test_saturation_is_the_greedy_loop(spark):
    rng = random.Random(1)
    rows = [(q, i, f"p{rng.randrange(3)}", rng.choice(["", "a", "b"]), rng.choice([0.25, 0.5, 1.0, 0.0])) for q in range(120) for i in rng.sample(range(30), rng.randrange(1, 9))]
    c = spark.createDataFrame(rows, "query_id int, chunk_id int, path string, text string, score double").cache()
    for limit, decay in ((3, 0.5), (0, 0.5), (2, 0.0), (4, 1.0)):
        got = {}
        for r in rerank.saturate(c, limit, decay).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.chunk_id)
        for q in range(120):
            assert got.get(q, []) == greedy([r[1:] for r in rows if r[0] == q], limit, decay), (q, limit, decay)


def test_bm25_phrases(spark):
    docs = spark.createDataFrame([(1, "go fast go_fast"), (2, "fast go"), (3, "fast"), (4, "x"), (5, None)], "chunk_id int, text string")
    q = spark.createDataFrame([(0, "go_fast"), (1, "fast"), (2, "fast fast"), (3, "how does")], "query_id int, query string")
    for index in (None, lexical.prepared(docs)):
        got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(q, docs if index is None else None, index).collect()}
        assert (0, 1) in got and (0, 3) in got  # the compound as a phrase, its part as a word
        assert {c for i, c in got if i == 1} == {1, 2, 3}
        assert got[2, 3] == pytest.approx(2 * got[1, 3])
        dl, n, avg = 4, 5, 8 / 5
        assert got[1, 1] == pytest.approx(1e-6 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * dl / avg)))


def test_boosts(spark):
    c = spark.createDataFrame([(0, 1, "lib/widget.py", "class Widget:", 1.0), (0, 2, "lib/x.py", "the Widget", 0.5), (1, 3, "src/retry_policy.py", "x", 1.0), (1, 4, "a.py", "def parseAll(", 0.2)], "query_id int, chunk_id int, path string, text string, score double")
    q = spark.createDataFrame([(0, "pkg::Widget", True), (1, "where retry policy parseAll", False)], "query_id int, query string, is_symbol boolean")
    extra = spark.createDataFrame([(9, "lib/widgets.py", "struct Widget {"), (8, "lib/widget2.py", "no")], "chunk_id int, path string, text string")
    got = {r.chunk_id: r.score for r in rerank.boosts(c, q, extra).collect()}
    assert got[1] == pytest.approx(1 + 4.5) and got[2] == 0.5 and got[9] == pytest.approx(4.5) and 8 not in got
    assert got[3] == pytest.approx(1 + 2 / 3) and got[4] == pytest.approx(0.2 + 1.5)


def test_vectors(spark):
    rng = random.Random(2)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, [0.0] * 8)]
    d = spark.createDataFrame(v, "chunk_id int, vec array<double>")
    got = vectors.nearest(d.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id"), d, 5, block_bytes=8 * 8 * 7).collect()
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max(1e-300, math.dist(a, [0] * 8) * math.dist(b, [0] * 8)), 6)
    for q in range(7):
        want = sorted(((-cos(v[q][1], b), i) for i, b in v))[:5]
        assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [i for _, i in want]
    assert vectors.drift([[1.0, 0.0]], [[1.0, 0.0]]) == "same" and vectors.drift([[1.0, 0.0]], [[0.0, 1.0]]) == "stale"


def test_refresh_and_evaluation(spark):
    old = spark.createDataFrame([("a", 5, 1), ("b", 5, 1), ("c", 5, 1)], "path string, mtime_ns long, size long")
    new = spark.createDataFrame([("a", 4, 1), ("b", 5, 1), ("d", 5, 1)], "path string, mtime_ns long, size long")
    assert {r.path: r.state for r in refresh.diff(new, old).collect()} == {"a": "changed", "b": "same", "c": "deleted", "d": "added"}
    hits = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (1, 1, "z")], "query_id int, rank int, key string")
    labels = spark.createDataFrame([(0, "y"), (0, "q"), (1, "z"), (2, "z")], "query_id int, key string")
    got = {r.query_id: r.ndcg for r in evaluate.ndcg(hits, labels).collect()}
    assert got == pytest.approx({0: (1 / math.log2(3)) / (1 + 1 / math.log2(3)), 1: 1.0, 2: 0.0})
    assert evaluate.bag_difference(old, old).count() == 0 and evaluate.bag_difference(old, new).count() == 4


def test_windows(spark):
    f = spark.createDataFrame([(1, "a", "x" * 400 + "\n" + "y" * 400 + "\nz"), (2, "b", "")], "file_id int, path string, text string")
    got = [(r.file_id, r.start_line, r.end_line) for r in chunks.line_windows(f).orderBy("file_id", "start_line").collect()]
    assert got == [(1, 1, 2), (1, 3, 3), (2, 1, 1)]
    assert [r.file_id for r in chunks.bounded(chunks.line_windows(f)).collect()] == [1]


def test_scope(spark):
    s = spark.createDataFrame([("src/a.py", "python", "code"), ("src/b.md", "markdown", "docs"), (None, "python", "code")], "path string, lang string, content_type string")
    keep = lambda **k: [r.path for r in s.where(symbols.scope(**k)).collect()]
    assert keep(include=("src/*",), exclude=("*.md",)) == ["src/a.py"] and keep(langs=("markdown",)) == ["src/b.md"] and len(keep()) == 3


def test_min_max(spark):
    d = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 1, 3.0)], "query_id int, chunk_id int, fused double")
    assert {(r.query_id, r.chunk_id): r.score for r in fusion.min_max(d).collect()} == {(0, 1): 1.0, (0, 2): 0.0, (1, 1): 1.0}


def test_innermost_is_linear(spark):
    """One file of 100,000 symbols, nested and not, against a sweep told otherwise; ties, nulls, no line."""
    rng = random.Random(4)
    defs = [(1, k, a := rng.randrange(1, 40_000), a + int(rng.paretovariate(0.7)) % 3000) for k in range(50_000)]
    defs += [(1, 90_001, 5, 5), (1, 90_000, 5, 5), (2, 90_002, 1, 9), (None, 90_003, 1, 9), (1, 90_004, 9, 3)]
    refs = [(1, 200_000 + k, rng.randrange(1, 43_000)) for k in range(50_000)] + [(1, 300_000, 5), (2, 300_001, 9), (2, 300_002, 10), (None, 300_003, 2), (2, 300_004, None)]
    got = symbols.innermost(spark.createDataFrame(refs, "file_id long, symbol_id long, start_line int").withColumn("enclosing_name", F.lit("x")), spark.createDataFrame(defs, "file_id long, symbol_id long, start_line int, end_line int"))
    assert got.columns == ["symbol_id", "file_id", "start_line", "enclosing_name", "enclosing_id"]
    best = {}
    for f, k, a, b in sorted((d for d in defs if d[0] == 1), key=lambda d: (d[3] - d[2], d[1]), reverse=True):
        best.update(dict.fromkeys(range(a, b + 1), k))  # shorter ones overwrite longer ones
    want = {i: best.get(line) for f, i, line in refs if f == 1} | {300_001: 90_002, 300_002: None, 300_003: None, 300_004: None}
    assert {r.symbol_id: r.enclosing_id for r in got.collect()} == want and want[300_000] == 90_000


def test_comments_and_distilled_text(spark):
    code = "// zero\n# one  \n\t/* two\n * three - four\n;; five\n--- six \nplain\n  /// seven //\ndef f():\n    return HTTPServer_v2\n" + "x = 1\n" * 20
    files = spark.createDataFrame([(1, "docs/readMe.md", code)], "file_id long, path string, text string")
    defs = spark.createDataFrame([(1, 10, 9, 30, "function"), (1, 11, 1, 30, "function"), (1, 12, 3, 30, None)], "file_id long, symbol_id long, start_line int, end_line int, kind string")
    got = {r.symbol_id: r for r in chunks.definition_chunks(defs, files).collect()}
    assert got[10].comments == "two three - four five six seven //" and got[11].comments == "" and got[12].comments == "zero one"
    kind = spark.createDataFrame([("function", "two", "f HTTPServer_v2 f"), (None, "", "f")], "kind string, comments string, text string")
    made = [r.t for r in kind.select(chunks.embed_text(F.lit("docs/readMe.md"), F.col("text"), F.col("kind"), F.col("comments")).alias("t")).collect()]
    assert made == ["docs read Me md :: function :: two :: f HTTP Server v 2", "docs read Me md :: f"]


def test_claims_of_one_position(spark):
    rows = [(1, 5, 10, "b"), (1, 5, 10, "a"), (1, 6, 2, "c"), (2, None, 1, "d"), (3, None, 1, "d"), (1, 7, 30, "e")]
    got = chunks.claimed_once(spark.createDataFrame([(s, i, p, t) for i, s, p, t in rows], "symbol_id long, chunk_id long, position int, text string").where("true"))
    assert got.where("symbol_id is not null").groupBy("symbol_id").count().where("count > 1").count() == 0


def test_nearest_in_blocks(spark):
    """Many blocks of either side, ties over block edges, a zero and a null vector, more asked than there are."""
    rng = random.Random(12)
    v = [(i, [float(rng.randrange(-1, 2)) for _ in range(4)]) for i in range(300)] + [(900, [0.0] * 4), (901, None)]
    d = spark.createDataFrame(v, "chunk_id long, vec array<double>").repartition(5)
    q = d.where("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / max(1e-300, math.dist(a, [0] * 4) * math.dist(b, [0] * 4)), 6)
    for k in (1, 7, 400):
        got = {}
        for r in vectors.nearest(q, d, k, block_bytes=4 * 8 * 40).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.chunk_id, r.score))
        assert set(got) == {i for i, x in v if i % 3 == 0 and x}
        for i, rows in got.items():
            want = sorted((-cos(v[i][1] if i < 300 else [0.0] * 4, x), j) for j, x in v if x)[:k]
            assert [(j, -s) for s, j in want] == [(c, s) for _, c, s in sorted(rows)]
    assert vectors.nearest(q.limit(0), d).count() == vectors.nearest(q, d.limit(0)).count() == 0
    many = spark.range(100_000).selectExpr("id as query_id", "array(1.0D, cast(id as double), 0.5D) as vec")
    plan = vectors.nearest(many, many.withColumnRenamed("query_id", "chunk_id"), 5, block_bytes=1 << 18)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Broadcast" not in plan and "Cartesian" not in plan


def test_paths_like(spark):
    rng = random.Random(5)
    paths = ["src/aXb.py", "a_b", "axb/c", "ab", "a\\b", "50%_off", "", "é_ü/x", "lib/Retry_Policy.go", *("".join(rng.choice("ab_x/") for _ in range(rng.randrange(1, 9))) for _ in range(120))]
    names = ["a_b", "A_B", "retry_policy", "___", "a\\b", "0%o", "_", "é_ü", "x__b", "zzz", *("".join(rng.choice("abx_") for _ in range(rng.randrange(1, 5))) for _ in range(40))]
    import re

    def like(path, name):
        parts = ["." if c == "_" else ".*" if c == "%" else re.escape(c) for c in name.lower()]
        return re.search("".join(parts), path.lower(), re.S) is not None

    df = spark.createDataFrame([(p,) for p in {*paths}] + [(None,)], "path string")
    asked = spark.createDataFrame([(n,) for n in {*names}] + [(None,)], "_n string")
    got = {(r.path, r._n) for r in rerank.paths_like(df, asked).collect()}
    assert got == {(p, n) for p in {*paths} for n in {*names} if like(p, n)}
    assert ("axb/c", "a_b") in got and ("a\\b", "a\\b") in got


def test_lookup_encoder(spark):
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("é", [9.0, 9.0])], "token string, row array<double>")
    rows = [(1, "A b"), (2, "a unknown"), (3, "unknown"), (4, ""), (5, None), (6, "b " * 600 + "a " * 600), (1, "A b")]
    got = vectors.pooled(spark.createDataFrame(rows, "chunk_id int, t string").withColumn("vec", F.lit(1)), "t", table, 2, 6).collect()
    vec = {r.chunk_id: r.vec for r in got}
    half = round(0.5**0.5, 6)
    assert len(got) == 7 and vec == {1: [half, half], 2: [1, 0], 3: [0, 0], 4: [0, 0], 5: [0, 0], 6: [0, 1]}


def test_learned_table(spark):
    """Words of one topic come to lie nearer to each other than to another's, and texts with them."""
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(30)] for t in ("sea", "road", "sky", "wood")]
    rows = [(k, " ".join(rng.choices(topics[k % 4], k=12) + rng.choices(["and", "the", "of"], k=6))) for k in range(600)]
    chunks_ = spark.createDataFrame(rows, "chunk_id long, text string")
    table = vectors.learned(chunks_, dims=8, vocabulary=200, sample=400)
    again = vectors.learned(chunks_.repartition(7), dims=8, vocabulary=200, sample=400)
    assert sorted(map(str, table.collect())) == sorted(map(str, again.collect()))
    made = vectors.pooled(chunks_, "text", table, 8)
    near = vectors.nearest(made.where("chunk_id < 40").withColumnRenamed("chunk_id", "query_id"), made.select("chunk_id", "vec"), 10).collect()
    right = sum(r.query_id % 4 == r.chunk_id % 4 for r in near) / len(near)
    assert right > 0.95
    assert vectors.learned(chunks_.limit(0), dims=4).count() == 0


def test_reachable_rows_are_few_and_enough(spark):
    rng = random.Random(4)
    rows = [(q, i, f"p{rng.randrange(40)}", rng.choice(["", "a", "b", *"cdefghijk"]), rng.choice([0.25, 0.5, 1.0, 0.0, 0.9])) for q in range(30) for i in rng.sample(range(400), rng.randrange(1, 200))]
    c = spark.createDataFrame(rows, "query_id int, chunk_id int, path string, text string, score double").cache()
    few = rerank.reachable(rerank.digested(c), 3).cache()
    assert few.count() < c.count() / 2 and few.columns == c.columns
    chosen = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.effective) for r in rerank.saturate(df, 3).collect())
    assert chosen(few) == chosen(c)


def test_words_of_few_queries_are_broadcast(spark):
    """A batch of queries is as small as its table, so a search does not deal out every posting."""
    from quarry.plans import proxies as px

    found = lexical.best(px.asked(spark, "/root/testdata/sf0.01"), lexical.prepared(px.chunks(spark, "/root/testdata/sf0.01")))
    plan = found._jdf.queryExecution().optimizedPlan()
    assert "embedding" not in plan.toString()


def test_lookup_sends_a_row_once_for_a_block(spark):
    """No exchange carries a row of the table for each time that a word occurs."""
    table = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, row array<double>")
    df = spark.createDataFrame([(i, "a b " * 300) for i in range(50)], "chunk_id int, t string")
    for texts in (7, 100):
        made = vectors.pooled(df, "t", table, 2, 6, texts=texts)
        assert {tuple(r.vec) for r in made.collect()} == {(round(0.5**0.5, 6),) * 2}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_texts_of_candidates_stay_out_of_the_windows(spark):
    """Judged candidates are boosted as those with texts are, and no text is dealt out by query."""
    held = spark.createDataFrame([(i, f"s/{n}.py", t) for i, (n, t) in enumerate([("retry", "class Retry(x)"), ("a", "class Retry\n"), ("retry", "Retry"), ("b", ""), ("retries", "x\nclass Retry:"), ("retry_x", "class Retry")])], "chunk_id bigint, path string, text string")
    q = spark.createDataFrame([(0, "Retry", True), (1, "how does retry work", False)], "query_id bigint, query string, is_symbol boolean")
    c = spark.createDataFrame([(0, 0, 1.0), (0, 2, 0.5), (0, 3, 0.25), (1, 1, 1.0), (1, 2, 0.5)], "query_id bigint, chunk_id bigint, score double")
    rows = lambda df: sorted((r.query_id, r.chunk_id, r.path, r.score) for r in df.collect())
    judged = rerank.judged(c, q, held)
    plain = rerank.boosts(c.join(held, "chunk_id").select("query_id", "chunk_id", "path", "text", "score"), q, held)
    made = rerank.boosts(judged, q, held)
    assert rows(made) == rows(plain) and len(rows(made)) == 6
    assert {r.text for r in made.where("chunk_id = 3").collect()} == {""} and {len(r.text) for r in made.where("chunk_id <> 3").collect()} == {64}


def test_word_queries_of_a_whole_search_carry_no_join(spark, monkeypatch):
    """Their words are then known to be few and are sent to the postings, not the postings to them."""

    from quarry.plans import queries as plans

    class Asked(Exception):
        pass

    def best(queries, *_, **__):
        raise Asked(queries._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(lexical, "best", best)
    with pytest.raises(Asked) as asked:
        plans.unranked_search(spark, "/root/testdata/sf0.001")
    assert "Join" not in str(asked.value)


def test_runs_of_words(spark):
    texts = ["a b c d", "  b\tc\x0bd\n", None, "", "caf\u00e9 b \u00a0c d e", "x" * 5000 + " b c d", "bc d", "d c b"]
    rows = spark.createDataFrame([*enumerate(texts)], "key bigint, text string").coalesce(1)
    got = {}
    for r in rows.mapInArrow(evaluate.runs(3), "key bigint, h bigint").collect():
        got.setdefault(r.key, []).append(r.h)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    want = {k: [tuple(w[i : i + 3]) for i in range(len(w) - 2)] for k, w in enumerate(split) if len(w) > 2}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    pairs = {(h, w) for k in want for h, w in zip(got[k], want[k])}
    assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


def test_labels_are_read_once(spark):
    labels = spark.range(5).selectExpr("id % 2 AS query_id", "id AS key")
    hits = spark.createDataFrame([(0, 1, 0), (0, 2, 9), (0, 3, 2), (1, 11, 1)], "query_id bigint, rank int, key bigint")
    found = evaluate.ndcg(hits, labels)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range") == 1
    got = {r.query_id: r.ndcg for r in found.collect()}
    assert got[0] == pytest.approx((1 + 0.5) / (1 + 1 / math.log2(3) + 0.5)) and got[1] == 0
