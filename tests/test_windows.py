"""Windows of trees and of text against the rule, step by step, and the DuckDB version over odd texts."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import windows as w
from quarry.operators import chunks
from quarry.plans import queries
from tests.test_scanner import SAMPLES

PYTHON = '''"""Doc."""
import os

@decorated(1)
class Boat(Vessel):
    """A boat."""
    limit = 3

    @property
    def length(self):
        if self.crew:
            return 1
        elif self.owner:
            return 2
        else:
            try:
                return f(é="漢")
            except ValueError:
                pass

    def move(self, to): return to

async def main():
    match x:
        case 1:
            print(1)
        case _:
            print(2)
# the end
'''
MARKDOWN = "intro\n\n# One\ntext a\ntext b\n\npara\n## Two\n```\n# no heading\n\ncode\n```\n# Three\nlast é line"
HTML = "<!DOCTYPE html><html><head><title>T</title><script>if (a < b) { '</div>' }</script></head><body><p>one<br>two<p>three</p><div class='a>b'><ul><li>x<li>y</ul><!-- <div> --></span> tail é</div></body>"


def by_rule(node, target, depth=0):
    """The grouping as it is told: recursive, one child after the other."""
    if not node.children or depth > w.MOST_DEPTH or node.end - node.start < w.LEAST_NODE:
        return [(node.start, node.end)]
    out, rest = [], list(node.children)
    while rest:
        c = rest.pop(0)
        if c.end - c.start > target:
            out += by_rule(c, target, depth + 1)
            continue
        group = [c]
        while rest and sum(g.end - g.start for g in group) + rest[0].end - rest[0].start <= target:
            group.append(rest.pop(0))
        out.append((group[0].start, group[-1].end))
    return out


def nested(node, data):
    """Children lie in order inside their parent, and leave out white space only."""
    todo = [node]
    while todo:
        node = todo.pop()
        at = node.start
        for c in node.children:
            assert at <= c.start < c.end <= node.end
            assert not data[at : c.start].strip(), data[at : c.start]
            at = c.end
        if node.children:
            assert not data[at : node.end].strip()
        todo += node.children


TEXTS = {"python": PYTHON, "markdown": MARKDOWN, "html": HTML, **{k: v[0] for k, v in SAMPLES.items()}}


@pytest.mark.parametrize("language", TEXTS)
def test_trees_and_grouping(language):
    for text in (TEXTS[language], TEXTS[language] * 3):
        data = text.encode()
        root = w.TREES[language](data)
        nested(root, data)
        for target in (1, 20, 60, 200, 750, 10_000):
            spans = w.grouped(root, target)
            assert spans == by_rule(root, target)
            joined = w.merged(spans, target)
            assert all(b <= c for (_, b), (c, _) in zip(joined, joined[1:]))
            covered = b"".join(data[a:b] for a, b in joined)
            assert b"".join(covered.split()) == b"".join(data.split())  # nothing but white space is left out
            for (a, b), (c, d) in zip(joined, [*joined[1:], (0, 0)]):
                own = [x for x in spans if a <= x[0] and x[1] <= b]
                assert len(own) == 1 or own[-2][1] - a + own[-1][1] - own[-1][0] <= target
                after = next((y - x for x, y in spans if x == c), None) if d else None
                assert after is None or b - a + after > target


def test_broken_trees():
    for language, tree in w.TREES.items():
        for text in ("", " ", "{", "}", "<div", "</div>", "<a><b></a></b>", "# ", "```\n# x", "if (", "{" * 2000, "<i>" * 3000, "é" * 40):
            data = text.encode()
            if (root := tree(data)) is not None:
                nested(root, data)
                w.tree_spans(data, language, 30)
    assert w.tree_spans(b"def (", "python", 750) is None


def test_long_spans_end_at_whole_characters():
    data = ("é漢" * 20_000).encode()
    spans = w.tree_spans(data, "html", 750)
    assert len(spans) > 4 and all(b - a <= w.MOST_BYTES for a, b in spans)
    assert "".join(data[a:b].decode() for a, b in spans) == "é漢" * 20_000


def by_character(text, most):
    """Text windows, told line by line over a list of lines."""
    lines, spans, open_, prior = text.splitlines(keepends=True), [], "", "x"
    for line in lines:
        if open_ and (len(open_) + len(line) > most or (not prior.strip() and line.strip() and 2 * len(open_) >= most - most % 2)):
            spans.append(open_)
            open_ = ""
        if len(line) > most:
            spans += [line[i : i + most] for i in range(0, len(line), most)]
        else:
            open_ += line
        prior = line
    return [*spans, open_] if open_ else spans


def test_text_windows():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bb ", "é", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", " ", "\xa0", "​", "漢" * 5]) for _ in range(rng.randrange(0, 60)))
        most = rng.randrange(1, 30)
        spans = w.text_spans(text, most)
        assert [text[a:b] for a, b in spans] == by_character(text, most)
        assert "".join(text[a:b] for a, b in spans) == text


def test_line_windows_are_those_of_the_plan(spark):
    rng = random.Random(2)
    rows = [(i, "p", None, "".join(rng.choice(["some words of a line", "é漢 ", "\n", "\n", "x" * 90]) for _ in range(rng.randrange(1, 90))) + "z") for i in range(60)]
    df = spark.createDataFrame(rows, "file_id long, path string, lang string, text string")
    for target in (1, 100, 750):
        want = chunks.bounded(chunks.line_windows(df, target))
        key = lambda r: (r.file_id, r.start_line, r.end_line, r.text.rstrip("\n"))
        assert sorted(map(key, w.windows(df, target).collect())) == sorted(map(key, want.collect()))
    assert w.line_spans(b"x" * 50_000 + b"\nend", 750) == [(0, 20_000), (20_000, 40_000), (40_000, 50_001), (50_001, 50_004)]


def test_windows_table(spark):
    long = "word " * 20 + "\n"
    rows = [(1, "a.py", "python", PYTHON * 4), (2, "b.py", "python", "def (\n" + long * 30), (3, "c", None, long * 9), (4, "d", "python", None), (5, "e", "html", ""), (6, "f", "rust", " \n "), (7, "g", "html", HTML * 9)]
    df = spark.createDataFrame(rows, "file_id long, path string, lang string, text string").withColumn("start_line", F.lit(0))
    got = w.windows(df, 300).collect()
    assert {r.file_id for r in got} == {1, 2, 3, 7}
    for r in got:
        lines = dict((i, t) for i, *_, t in rows)[r.file_id].split("\n")
        assert r.text.strip() in "\n".join(lines[r.start_line - 1 : r.end_line])
        assert len(r.text.strip()) >= 60
    assert w.windows(df.limit(0)).collect() == []


def test_text_windows_sql(spark, tmp_path):
    """The registered query and its SQL over odd line ends, blank lines and long lines."""
    rng = random.Random(11)
    part = ["some words of a line ", "x" * 400, "\n", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", " ", "\xa0", "é漢 "]
    rows = [(i, "".join(rng.choice(part) for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(500, None), (501, ""), (502, "y" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["text_windows"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['text_windows']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 100
