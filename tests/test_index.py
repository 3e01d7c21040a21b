"""A small tree from walk to search, and its life."""

import json
import os

import pytest

from quarry import cli
from quarry.extract import keyword_symbols, markdown_symbols, python_symbols
from quarry.index import Busy, Index
from quarry.settings import ConfigError, Settings, as_toml, load
from quarry.sources.tree import walk

CODE = '''"""Retry helpers for the client, long enough to be a chunk of its own in the index."""

LIMIT = 3


class RetryPolicy:
    """Decides how often a request is sent again, and how long to wait between two tries."""

    def wait(self, attempt: int) -> float:
        return backoff(attempt) * self.factor


def backoff(attempt):
    """Seconds before the next attempt; grows with every failed one until a ceiling is met."""
    return min(2.0**attempt, 60.0)
'''


@pytest.fixture
def root(tmp_path):
    put = lambda name, text: ((tmp_path / name).parent.mkdir(parents=True, exist_ok=True), (tmp_path / name).write_text(text))
    put("pkg/__init__.py", "from pkg.retry import RetryPolicy, backoff\n" * 3)
    put("pkg/retry.py", CODE)
    put("tests/test_retry.py", "from pkg.retry import backoff\n\n\ndef test_backoff_grows_with_each_attempt():\n    assert backoff(2) > backoff(1) and backoff(100) == 60.0\n")
    put("README.md", "# Retries\n\nHow retries are handled: the policy waits between attempts and gives up at a limit.\n\n## Limits\n\nAt most three attempts are made for each request that the client sends.\n")
    put(".gitignore", "build/\n*.log\n")
    put(".quarryignore", "!keep.log\n")
    put("build/x.py", "x = 1\n")
    put("a.log", "x\n")
    put("keep.log", "x\n")
    put(".github/ci.toml", "a = 1\n")
    return tmp_path


def test_walk(root):
    os.symlink(root / "pkg", root / "link")
    paths = [p for p, *_ in walk(str(root))]
    assert {"pkg/__init__.py", ".github/ci.toml", "keep.log", ".gitignore"} <= set(paths)
    assert not {"build/x.py", "a.log", "link/retry.py"} & set(paths)


def test_extraction():
    rows = python_symbols(CODE)
    assert [(r[0], r[2], r[3]) for r in rows if r[1] == "def"] == [("LIMIT", 3, 3), ("RetryPolicy", 6, 10), ("wait", 9, 10), ("backoff", 13, 15)]
    assert {(r[0], r[2], r[5]) for r in rows if r[1] == "ref"} >= {("backoff", 10, "wait"), ("factor", 10, "wait"), ("min", 15, "backoff"), ("int", 9, "wait")}
    assert python_symbols("def (") == []
    assert [r[:4] for r in markdown_symbols("# A\nx\n## B\n```\n# no\n```\n# C")] == [("A", "def", 1, 2), ("B", "def", 3, 6), ("C", "def", 7, 7)]
    got = keyword_symbols("fn main() {\n  run(1);\n}\nstruct S {\n}\n")
    assert [r[:4] for r in got if r[1] == "def"] == [("main", "def", 1, 3), ("S", "def", 4, 5)]
    assert ("run", "ref", 2, 2, None, "main", None) in got


def test_life(spark, root):
    index = Index(spark, str(root), Settings(refresh_mode="manual"))
    first = index.refresh()
    assert first["added"] == 6
    assert [r.path for r in index.definitions("backoff").collect()] == ["pkg/retry.py"]
    refs = [(r.path, r.enclosing) for r in index.references("backoff").collect()]
    assert ("pkg/retry.py", "wait") in refs and ("tests/test_retry.py", "test_backoff_grows_with_each_attempt") in refs
    q = spark.createDataFrame([(0, "RetryPolicy"), (1, "how are retries handled between attempts")], "query_id int, query string")
    hits = index.search(q, 3).orderBy("query_id", "rank").collect()
    top = {r.query_id: r for r in hits if r.rank == 1}
    assert top[0].path == "pkg/retry.py" and top[0].score == 1.0 and "exact" in top[0].tiers
    assert top[1].path in ("README.md", "pkg/retry.py")
    (root / "pkg/retry.py").write_text(CODE.replace("backoff", "delay"))
    (root / "README.md").unlink()
    (root / "new.py").write_text("def fresh():\n    return 1\n")
    again = index.refresh()
    assert (again["added"], again["changed"], again["deleted"]) == (1, 1, 1)
    assert index.definitions("backoff").count() == 0 and index.definitions("delay").count() == 1 and index.definitions("fresh").count() == 1
    assert index.table("chunk").where("path = 'README.md'").count() == 0
    assert index.table("vector").count() == index.table("chunk").count()
    counts, total = index.symbol_counts("lang", tag="def")
    assert counts.first().key == "python" and total.first().groups >= 1
    assert index.clear() and not index.clear()


def test_cli(spark, root, capsys):
    run = lambda *a: cli.main([*a, "--root", str(root)], spark)
    assert run("index") == 0 and json.loads(capsys.readouterr().out)["added"] == 6
    assert run("defs", "wait") == 0
    out = json.loads(capsys.readouterr().out)
    assert out["count"] == 1 and out["symbols"][0]["start_line"] == 9
    assert run("defs", "wait", "--lang", "pythn") == 2 and "did you mean 'python'" in capsys.readouterr().err
    assert run("search", "backoff", "--content", "nope") == 2
    assert run("symbols", "*", "--count-by", "tag") == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["groups"] == 2
    assert run("search", "backoff", "-k", "2") == 0
    assert json.loads(capsys.readouterr().out)["results"][0]["tiers"]["exact"] == 1.0
    assert run("status") == 0 and json.loads(capsys.readouterr().out)["files"] == 6


def test_settings(tmp_path):
    user, repo = tmp_path / "u.toml", tmp_path / "r.toml"
    user.write_text("[retrieval]\nalpha_prose = 1\nranker = 'none'\n")
    repo.write_text("ranker = 'rrf'\n")
    s = load(user, repo, {"QUARRY_CANDIDATE_DEPTH": "7", "QUARRY_CONTENT": "code, docs", "QUARRY_RERANK": "off"})
    assert (s.ranker, s.alpha_prose, s.candidate_depth, s.content, s.rerank) == ("rrf", 1.0, 7, ("code", "docs"), False)
    for bad in ("nope = 1", "ranker = 'x'", "rerank = 1", "embed_api_key = 'k'"):
        repo.write_text(bad)
        with pytest.raises(ConfigError):
            load(None, repo, {})
    repo.write_text(as_toml(s))
    assert load(None, repo, {}) == s


def test_unchanged_tree_reports_nothing(spark, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    return 1\n")
    (tmp_path / "bundle.js").write_text("x" * 32_000)
    index = Index(spark, str(tmp_path), Settings(refresh_mode="manual"))
    assert index.refresh()["added"] == 1
    before = index.meta()["version"]
    again = index.refresh()
    assert (again["added"], again["changed"], again["deleted"]) == (0, 0, 0) and index.meta()["version"] == before
    (tmp_path / "bundle.js").write_text("var a = 1;\n" * 30)
    (tmp_path / "a.py").write_text("z = 1\n" + "y" * 32_000)
    third = index.refresh()
    assert (third["added"], third["changed"], third["deleted"]) == (1, 0, 1)
    assert [r.path for r in index.table("file").collect()] == ["bundle.js"]


def test_settings_shape_the_index(spark, tmp_path):
    body = "def long():\n" + "".join(f"    value_{i} = compute({i})\n" for i in range(40))
    (tmp_path / "a.py").write_text(body)
    (tmp_path / "check_a.py").write_text(body.replace("long", "other"))
    settings = Settings(refresh_mode="manual", max_chunk_lines=10, test_markers=("check",), doc_languages=("toml",), config_languages=())
    (tmp_path / "b.toml").write_text("[x]\n" + "key = 'a value of some length'\n" * 5)
    index = Index(spark, str(tmp_path), settings)
    index.refresh()
    kinds = {r.path: r.content_type for r in index.table("file").collect()}
    assert kinds == {"a.py": "code", "check_a.py": "tests", "b.toml": "docs"}
    spans = index.table("chunk").where("symbol_id is not null").selectExpr("max(end_line - start_line + 1)").first()[0]
    assert spans == 10


def test_weights_follow_the_settings(spark):
    from quarry.operators import fusion

    q = spark.createDataFrame([(1, True), (2, False)], "query_id int, is_prose boolean")
    got = {(r.query_id, r.tier): round(r.weight, 6) for r in fusion.weights(q, True, 0.9, 0.2).collect()}
    assert got[1, "vector"] == 0.9 and got[1, "lexical"] == 0.1 and got[2, "vector"] == 0.2 and got[2, "lexical"] == 0.8


def test_every_language_key(spark):
    from quarry.functions import classify
    from quarry.functions.languages import LANGUAGES

    paths = [(f"d/x{k}" if k.startswith(".") else f"d/{k}", v) for k, v in LANGUAGES.items()]
    got = {r.path: r.lang for r in classify.with_language(spark.createDataFrame([(p,) for p, _ in paths], "path string")).collect()}
    assert got == dict(paths)


def test_stored_keyword_index(spark, root):
    from quarry.operators import lexical, postings

    index = Index(spark, str(root), Settings(refresh_mode="manual"))
    index.refresh()
    (root / "pkg/retry.py").write_text(CODE.replace("ceiling", "threshold"))
    (root / "README.md").unlink()
    index.refresh()
    want = lexical.prepared(index.table("chunk"), "keyword_text")
    stored = index._keyword_index(index.meta())
    have = postings.flat(spark, stored), *(spark.read.parquet(f"{stored.folder}/{t}") for t in ("lengths", "statistics"))
    for now, fresh in zip(have, want):
        rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
        assert rows(now) == rows(fresh)
    terms = {r.term for r in have[0].select("term").distinct().collect()}
    assert "ceiling" not in terms and "threshold" in terms


def test_killed_refresh(spark, root, monkeypatch):
    """Whatever a refresh leaves when it is killed, the next one comes about, and readers have the version before."""
    index = Index(spark, str(root), Settings(refresh_mode="manual"))
    index.refresh()
    (root / "pkg/retry.py").write_text(CODE.replace("backoff", "delay"))
    for step in ("_chunks", "_keywords", "_publish"):
        with monkeypatch.context() as m:
            m.setattr(Index, step, lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
            with pytest.raises(KeyboardInterrupt):
                index.refresh()
        assert index.definitions("backoff").count() == 1
    (index.home / "draft-dead.json").write_text("{")
    assert index.refresh()["changed"] == 1 and index.definitions("delay").count() == 1
    assert len(list(index.home.glob("v-*"))) == 2 and not list(index.home.glob("draft-*"))


def test_two_writers(spark, root):
    first, second = (Index(spark, str(root), Settings(rescan_after_seconds=0)) for _ in range(2))
    with first._writing():
        with pytest.raises(Busy):
            second.fresh()  # never built: nothing to serve
    first.refresh()
    held = second.definitions("backoff")
    (root / "pkg/retry.py").write_text(CODE.replace("backoff", "delay"))
    with first._writing():
        with pytest.raises(Busy):
            second.refresh()
        second.fresh()  # serves what there is
        assert second.definitions("backoff").count() == 1
    # Where the system's lock does not hold, the manifest's number does: of two from one version one comes about.
    old = first.meta()
    first._publish(old, old | {"scanned": 1})
    with pytest.raises(Busy):
        second._publish(old, old | {"scanned": 2})
    assert first.meta()["scanned"] == 1
    second.fresh()
    assert second.definitions("delay").count() == 1 and held.count() == 1  # a reader keeps its version


def test_identity_has_the_extractor(monkeypatch):
    from quarry import extract, index

    before = index.identity(Settings())
    monkeypatch.setattr(extract, "REVISION", extract.REVISION + 1)
    assert index.identity(Settings()) != before


def test_canary(spark, root):
    index = Index(spark, str(root), Settings(refresh_mode="manual"))
    index.refresh()
    q = spark.createDataFrame([(0, "seconds before the next attempt")], "query_id int, query string")
    assert "vector" in index.search(q, 1).first().tiers
    meta = index.meta()
    index._publish(meta, meta | {"canary": [[-x for x in v] for v in meta["canary"]]})
    with pytest.warns(UserWarning, match="left out"):
        assert "vector" not in index.search(q, 1).first().tiers


def test_learned_encoder(spark, root):
    index = Index(spark, str(root), Settings(refresh_mode="manual", embed_model="lookup-8"))
    index.refresh()
    before = sorted(map(str, index.table("token").collect()))
    (root / "new.py").write_text("def fresh():\n    return 1\n" + "value = 'unheard of'\n" * 9)
    index.refresh()
    assert sorted(map(str, index.table("token").collect())) == before  # one table, one space
    assert {len(r.vec) for r in index.table("vector").collect()} == {8} and index.table("vector").count() == index.table("chunk").count()
    q = spark.createDataFrame([(0, "seconds before the next attempt")], "query_id int, query string")
    assert "vector" in index.search(q, 1).first().tiers


def test_distilled_documentation(spark, root):
    plain, short = (Index(spark, str(root), Settings(refresh_mode="manual", distill_docs=d, data_dir=str(root / f".quarry-{d}"))) for d in (False, True))
    plain.refresh(), short.refresh()
    vec = lambda i, path: {tuple(r.vec) for r in i.table("vector").join(i.table("chunk").where(f"path = '{path}'"), "chunk_id").collect()}
    assert vec(plain, "README.md") != vec(short, "README.md") and vec(plain, "pkg/retry.py") == vec(short, "pkg/retry.py")
