"""Exact dedup by block naming against grouped texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from quarry.llm import blocknames

HEADER = "doc_id bigint, text string, run int, kept string"
WHITE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(WHITE)].append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        x = (t or "").translate(WHITE)
        _, none, keep = min(groups[x])
        out.append((i, None if none else keep, len(groups[x]), hashlib.sha256(x.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("block,run_bytes", [(1, 1), (3, 400), (4096, 16 << 20)])
def test_dedup(spark, block, run_bytes):
    rng = random.Random(block)
    base = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 24))) for _ in range(40)]
    base += ["", " ", None, "\x00", "\x00\x00", "\x0b\x85", "é 漢字", "ab" * 700, "ab" * 699 + "aa", "a" * 7, "a" * 8, "a" * 9]
    texts = [rng.choice(base) for _ in range(120)] + base + [t.replace("a", "a\r ") for t in base if t] + ["hot text"] * 60
    ids = [rng.randrange(50) if k % 9 else None for k in range(len(texts))]
    rows = list(zip(ids, texts))
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], HEADER).repartition(4)
    got = blocknames.dedup(docs, block, run_bytes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(plain(rows), key=key)
    # One identity for each text, one row of each identity stays: the one it names.
    names = defaultdict(set)
    for r in got:
        names[r.level, r.name].add(r.text_sha256)
    assert all(len(x) == 1 for x in names.values()) and len(names) == len({r.text_sha256 for r in got})
    stay = [(r.level, r.name) for r in got if r.kept]
    assert len(stay) == len(set(stay)) == len(names)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    again = blocknames.dedup(docs.repartition(2), block, run_bytes).collect()
    assert {(r.level, r.name, r.text_sha256) for r in got} == {(r.level, r.name, r.text_sha256) for r in again}  # whatever the layout


def test_local_names():
    rng = random.Random(1)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    names = blocknames.names_of(texts)
    assert all((x == y) == (p == q) for x, p in zip(texts, names) for y, q in zip(texts, names))


def test_none(spark):
    assert blocknames.digest(spark.createDataFrame([], HEADER)).collect() == []
    got = blocknames.digest(spark.createDataFrame([(None, None, 1, ""), (None, " ", 1, "")], HEADER)).collect()
    assert [(r.keep_id, r.group_size) for r in got] == [(None, 2)] * 2 and sum(r.kept for r in got) == 1
