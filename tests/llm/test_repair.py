"""Conversation repair against a search over all edits, and the DuckDB version over odd rows."""

import heapq
import random
import re

import duckdb
import pytest

from quarry.llm import repair

HEADER = "conv_id bigint, turn int, role string, text string, audit string"


def plain(turns):
    """(faults, cost, audit, lines) by Dijkstra's search over (cost, audit), turns being in order."""
    seen, faults = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    ok = re.compile(r"(s?(ua)+)?")
    partial = re.compile(r"s?(ua)*u?")
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, shape, lines = heapq.heappop(queue)
        if i == len(turns) and ok.fullmatch(shape):
            return faults, cost, audit, lines
        state = i, shape[-1:]
        if state in done:
            continue
        done.add(state)
        steps = [("I", 2, r, ("user" if r == "u" else "assistant") + ":", 0) for r in "ua"]
        if i < len(turns):
            role, text = turns[i]
            steps.append(("D", 3, "", None, 1))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                steps.append(("K", more, role[:1], f"{role}:{text}", 1))
                steps += [("R", 2 + more, n[0], f"{n}:{text}", 1) for n in ("user", "assistant")]
        for letter, price, initial, line, on in steps:
            if letter == "D" or (initial and partial.fullmatch(shape + initial)):
                heapq.heappush(queue, (cost + price, audit + letter, i + on, shape + initial if letter != "D" else shape, lines if line is None else (*lines, line)))


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    roles = ["system", "user", "assistant", "tool", "u", "", " ", "Assistant", "é"]
    texts = ["Yes.", "No!", "why? ", "cut off", "", " \n", "...", "Yes.", "漢字", ". \x85", "two\nlines."]
    out = []
    for c in range(300):
        legal = rng.random() < 0.4
        for t in range(rng.randrange(1, 9)):
            turn = rng.choice([t, t, t, t + 3, None])
            out.append((c, turn, ["user", "assistant"][t % 2] if legal else rng.choice(roles), rng.choice(texts[:4] if legal else texts)))
    out += [(None, t, "user", f"line {t}.") for t in range(4)]
    return out + [(1000, t, "ua"[t % 2], f"{t % 17}.") for t in range(400)]


def test_repair(spark, rows):
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame([(*r, "clash") for r in rows], HEADER).repartition(3)).collect()}
    assert got.keys() == {r[0] for r in rows}
    for c, r in got.items():
        mine = order([x for x in rows if x[0] == c])
        turns = [x[2:] for x in mine]
        faults, cost, audit, lines = plain(turns)
        assert (r.cost, r.audit) == (cost, audit), (turns, r)
        assert [f"{t.role}:{t.text}" for t in r.turns] == list(lines)
        assert (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, ("blank", "duplicate", "truncated")))
        numbers = [x[1] for x in mine if x[1] is not None]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert r.illegal == sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:]))


def test_damaged(spark, rows):
    """All columns of the query over odd rows, nulls too, as the SQL has them."""
    rng = random.Random(2)
    rows = [(c, t, None if rng.random() < 0.05 else role, None if rng.random() < 0.05 else text) for c, t, role, text in rows]
    df = spark.createDataFrame([(*r, "clash") for r in rows], HEADER).repartition(3)
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = repair.digest(df)
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({repair.SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    cases = {r.case for r in df.selectExpr("crc32(cast(concat(conv_id, ':', turn) as binary)) % 20 as case").distinct().collect()}
    assert cases >= {0, 1, 2, 3, 4}


def test_gone(spark):
    none = spark.createDataFrame([], HEADER)
    assert repair.digest(none).collect() == []
    lost = spark.createDataFrame([(7, 1, "user", "Hi.", None, False), (7, 2, "user", "Ho.", None, None)], HEADER + ", here boolean")
    assert [tuple(r) for r in repair.repair(lost, lost["here"]).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", [])]
