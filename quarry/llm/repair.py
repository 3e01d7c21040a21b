"""Conversation structure repair by a time-major tensor of backward costs.

The roles of a conversation are to read `(s?(ua)+)?`: nothing, or an optional system turn and then
pairs of user and assistant.  An automaton of four states says what has been read: nothing, system,
user, assistant; nothing and assistant may be the end.  Every turn is kept, given another role or
deleted, and empty turns are inserted anywhere, at the least cost.

Conversations of one length are a bucket.  Its costs are one tensor (turn, conversation, state),
filled from the last turn to the first, a turn of all conversations at once: the least cost of what is
left.  The edits are read off forwards, one of every conversation at once: of those that keep to the
least cost, the letter that sorts first, which makes the whole audit the least of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.arrowtext import small_batches

#: Arrow bytes of turns handled at once; one longer conversation is handled whole.
RUN_BYTES = 8 << 20
#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted (or rerolled) turn: its role is the one that may come next.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept turn of each initial (s, u, a, any other); NEVER leads nowhere.
NEVER = 4
KEPT = np.array([[SYSTEM, NEVER, NEVER, NEVER], [USER, USER, NEVER, USER], [NEVER, NEVER, ASSISTANT, NEVER], [NEVER] * 4])
ENDS = np.array([True, False, False, True])
FAR = np.int64(1) << 40
#: Adjacent initials that are legal, as pairs of codes.
LEGAL = {(0, 1), (1, 2), (2, 1)}
LETTERS = b"DIKR"

RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, turns array<struct<role:string,text:string>>"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `present` of the turns that the contract damages.

    By crc32 of `conv_id:turn` modulo 20: 0 takes the turn away (a row stays that is not present, so
    that its conversation is known), 1 empties its text, 2 takes `.`, `!` and `?` out of it, 3 repeats
    it, 4 makes its role user.  Nulls count as one space; a null conv_id or turn itself stays null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("case", case)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), (F.col("case") != 0).alias("present"))


def backward(initial: np.ndarray, must: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """cost[t, c, s]: the least cost of conversation c from turn t on in state s.

    `initial`, `must` (the turn has to be deleted) and `extra` (cost of a turn that is not deleted)
    are of shape (turns, conversations).
    """
    turns, n = initial.shape
    cost = np.full((turns + 1, n, 5), FAR, np.int64)  # the last state is NEVER
    cost[turns, :, :4] = np.where(ENDS, 0, FAR)
    for t in range(turns, -1, -1):
        now = cost[t]
        if t < turns:
            after = cost[t + 1]
            keep = np.take_along_axis(after, KEPT[initial[t]], 1) + extra[t][:, None]
            rerole = after[:, NEXT] + REROLE + extra[t][:, None]
            keep[must[t]] = rerole[must[t]] = FAR
            now[:, :4] = np.minimum(np.minimum(keep, rerole), after[:, :4] + DELETE)
        user, assistant = now[:, USER].copy(), now[:, ASSISTANT].copy()
        now[:, USER] = np.minimum(user, assistant + INSERT)
        now[:, ASSISTANT] = np.minimum(assistant, user + INSERT)
        for s in (START, SYSTEM):
            now[:, s] = np.minimum(now[:, s], now[:, USER] + INSERT)
    return cost


def trace(cost: np.ndarray, initial: np.ndarray, must: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, state after each, edits of each conversation); edits index LETTERS, one column a conversation."""
    turns, n = initial.shape
    edits, states = [], []
    t, s, length = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.arange(n)
    while True:
        live = live[(t[live] < turns) | ~ENDS[s[live]]]
        if not len(live):
            break
        i, q = t[live], s[live]
        row, more = np.minimum(i, turns - 1), i < turns
        least = cost[i, live, q]
        late = np.minimum(i + 1, turns)
        first, stay = initial[row, live], more & ~must[row, live] if turns else more
        add = extra[row, live]
        deleted = more & (cost[late, live, q] + DELETE == least)
        inserted = cost[i, live, NEXT[q]] + INSERT == least
        kept = stay & (cost[late, live, KEPT[first, q]] + add == least)
        edit = np.select([deleted, inserted, kept], [0, 1, 2], 3)
        to = np.select([edit == 0, edit == 2], [q, KEPT[first, q]], NEXT[q])
        column, place = np.full(n, -1, np.int8), np.full(n, -1, np.int8)
        column[live], place[live] = edit, to
        edits.append(column)
        states.append(place)
        t[live] += edit != 1
        s[live] = to
        length[live] += 1
    shape = (len(edits), n)
    return np.array(edits, np.int8).reshape(shape), np.array(states, np.int8).reshape(shape), length


def _faults(t: pa.Table, conv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blank, duplicate, truncated) of each turn: its first fault only."""
    trimmed = pc.ascii_rtrim(t["text"], characters=WHITE)
    blank = pc.equal(pc.binary_length(trimmed), 0).to_numpy()
    codes = [pc.dictionary_encode(t[c].combine_chunks()).indices.to_numpy() for c in ("role", "text")]
    order = np.lexsort((np.arange(len(conv)), codes[0], codes[1], conv))
    again = np.zeros(len(conv), bool)
    same = np.ones(max(0, len(conv) - 1), bool)
    for x in (conv, *codes):
        same &= x[order][1:] == x[order][:-1]
    again[order[1:]] = same
    ended = pc.match_substring_regex(trimmed, r"[.!?]$").to_numpy()
    duplicate = again & ~blank
    return blank, duplicate, ~(ended | blank | duplicate)


def _repaired(t: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
    """RESULT of the conversations `bounds[k]:bounds[k+1]`, whose turns are in order."""
    n = len(bounds) - 1
    conv = np.repeat(np.arange(n), np.diff(bounds))
    ids = t["conv_id"].combine_chunks().take(pa.array(bounds[:-1]))
    here = t["present"].to_numpy()
    t, conv = t.filter(t["present"]), conv[here]
    blank, duplicate, truncated = _faults(t, conv)
    length = np.bincount(conv, minlength=n)
    start = np.cumsum(length) - length
    role = pc.utf8_slice_codeunits(t["role"], 0, 1).combine_chunks()
    initial = np.select([pc.equal(role, x).to_numpy(zero_copy_only=False) for x in "sua"], [0, 1, 2], 3)
    many = lambda flag: np.bincount(conv, weights=flag, minlength=n).astype(np.int64)
    good = np.array([[(x, y) in LEGAL for y in range(4)] for x in range(4)])
    illegal = np.zeros(len(conv), bool)
    illegal[1:] = (conv[1:] == conv[:-1]) & ~good[initial[:-1], initial[1:]]
    # Numbers missing among the turns, which come in order with nulls first.
    gaps = np.zeros(n, np.int64)
    number, known = t["turn"].fill_null(0).to_numpy(), pc.is_valid(t["turn"]).to_numpy()
    if known.any():
        c, x = conv[known], number[known]
        step = np.where(c[1:] == c[:-1], np.maximum(x[1:] - x[:-1] - 1, 0), 0)
        gaps = np.bincount(c[1:], weights=step, minlength=n).astype(np.int64)
    roles, texts = t["role"].to_pylist(), t["text"].to_pylist()
    cost, audit, turns = np.zeros(n, np.int64), [""] * n, [[] for _ in range(n)]
    for size in np.unique(length[length > 0]).tolist():
        bucket = np.flatnonzero(length == size)
        at = start[bucket] + np.arange(size)[:, None]  # turns down, conversations across
        tensors = initial[at], (blank | duplicate)[at], truncated[at] * TRUNCATED
        costs = backward(*tensors)
        cost[bucket] = costs[0, :, START]
        edits, states, steps = trace(costs, *tensors)
        for k, (c, many_steps) in enumerate(zip(bucket.tolist(), steps.tolist())):
            own, row, out = edits[:many_steps, k], start[c], turns[c]
            audit[c] = np.frombuffer(LETTERS, np.uint8)[own].tobytes().decode()
            for letter, state in zip(audit[c], states[:many_steps, k].tolist()):
                made = "user" if state == USER else "assistant"
                if letter == "I":
                    out.append({"role": made, "text": ""})
                    continue
                if letter != "D":
                    out.append({"role": roles[row] if letter == "K" else made, "text": texts[row]})
                row += 1
    pairs = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    whole = [pa.array(x, pa.int64()) for x in (gaps, many(blank), many(duplicate), many(truncated), many(illegal), cost)]
    return pa.RecordBatch.from_arrays([ids, *whole, pa.array(audit, pa.string()), pa.array(turns, pairs)], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(turns, bounds) of whole conversations, from rows in their order."""
    have: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        have = pa.Table.from_batches([b]) if have is None else pa.concat_tables([have, pa.Table.from_batches([b])])
        if have.nbytes >= RUN_BYTES:
            bounds = _bounds(have)
            if len(bounds) > 2:  # the last conversation may go on
                yield have.slice(0, bounds[-2]), bounds[:-1]
                have = have.slice(bounds[-2])
    if have is not None and have.num_rows:
        yield have, _bounds(have)


def _bounds(t: pa.Table) -> np.ndarray:
    known, ids = pc.is_valid(t["conv_id"]).to_numpy(), t["conv_id"].fill_null(0).to_numpy()
    new = np.flatnonzero((known[1:] != known[:-1]) | (ids[1:] != ids[:-1])) + 1
    return np.concatenate([[0], new, [len(ids)]])


def repair(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """A row for every conv_id: its faults, the cheapest edits, and the turns that they leave.

    Turns come by number, null ones first, turns of one number by role and text.  A turn's first
    fault counts: blank (no character outside `[\\x20\\x09-\\x0D]`), duplicate (its role and text were
    there before), truncated (the last such character is none of `.!?`).  gaps are numbers missing
    between the least and the largest; illegal are neighbours whose initials are not su, ua or au.
    Edits keep a turn (K), give it the role user or assistant (R, 2), delete it (D, 3; blank and
    duplicate ones must go) or insert an empty turn (I, 2); a truncated turn that stays costs 1.
    audit has their letters, the least of the cheapest.  A null role or text is one space, a null
    conv_id a conversation of its own.  Rows where `present` does not hold only name their
    conversation; one without any other row has zeros and no turns.  Columns other than conv_id,
    turn, role and text are left out.  An empty table gives no rows.

    The turns of one conversation are one result and meet in one task, in a sort that spills.
    """
    here = F.coalesce(present, F.lit(False)) if present is not None else F.lit(True)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), here.alias("present"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _conversations(batches):
            yield _repaired(t, bounds)

    small_batches(turns.sparkSession)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, RESULT)


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns: `repair` of the damaged turns, with a hash of what is left."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    repaired = repair(damage(conversations), F.col("present"))
    return repaired.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n").cast("binary"), 256)).drop("turns")


#: DuckDB SQL of `digest`: the cheapest edits forwards, a cost, an audit and the text for each state.
#: The checksum is the reflected CRC-32 of polynomial 0xEDB88320.
SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([k] || range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY k) AS tab
  FROM (SELECT unnest(range(256)) AS k)),
hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce([4294967295] || list_transform(range(1, length(digits) + 1, 2), lambda i: CAST('0x' || substr(digits, i, 2) AS BIGINT)),
             lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 AS k
  FROM (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS digits FROM conversations), tab),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed),
numbered AS (SELECT *, left(role, 1) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered),
size AS (
  SELECT o.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY o.conv_id),
inserts(s, s2, cost, audit, lines) AS (
  SELECT * FROM (VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []),
    ('0', 'u', 2, 'I', ['user:']), ('s', 'u', 2, 'I', ['user:']), ('a', 'u', 2, 'I', ['user:']), ('u', 'a', 2, 'I', ['assistant:']),
    ('0', 'a', 4, 'II', ['user:', 'assistant:']), ('s', 'a', 4, 'II', ['user:', 'assistant:']))),
edits(s, c, s2, cost, letter) AS (
  SELECT * FROM (VALUES ('0', 's', 's', 0, 'K'), ('0', 'u', 'u', 0, 'K'), ('s', 'u', 'u', 0, 'K'), ('a', 'u', 'u', 0, 'K'), ('u', 'a', 'a', 0, 'K'),
    ('0', NULL, 'u', 2, 'R'), ('s', NULL, 'u', 2, 'R'), ('a', NULL, 'u', 2, 'R'), ('u', NULL, 'a', 2, 'R'),
    ('0', NULL, '0', 3, 'D'), ('s', NULL, 's', 3, 'D'), ('u', NULL, 'u', 3, 'D'), ('a', NULL, 'a', 3, 'D'))),
walk(conv_id, i, s, best) AS (
  SELECT conv_id, 0::BIGINT, '0', {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM size WHERE n > 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, e.s2, min({
      'cost': (w.best.cost + x.cost + e.cost + CASE WHEN e.letter <> 'D' AND j.fault = 't' THEN 1 ELSE 0 END)::BIGINT,
      'audit': w.best.audit || x.audit || e.letter,
      'lines': w.best.lines || x.lines || CASE e.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [j.role || ':' || j.text]
               ELSE [CASE e.s2 WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text] END})
  FROM walk w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i + 1
  JOIN inserts x ON x.s = w.s JOIN edits e ON e.s = x.s2 AND (e.c IS NULL OR e.c = j.c) AND (e.letter = 'D' OR j.fault NOT IN ('b', 'd'))
  GROUP BY w.conv_id, w.i, e.s2),
ended AS (
  SELECT w.conv_id, min({'cost': w.best.cost + x.cost, 'audit': w.best.audit || x.audit, 'lines': w.best.lines || x.lines}) AS best
  FROM walk w JOIN size z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.i JOIN inserts x ON x.s = w.s WHERE x.s2 IN ('0', 'a') GROUP BY w.conv_id)
SELECT z.conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM size z LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM z.conv_id
"""
