"""Token alignment against a byte-by-byte version, an id for id."""

import hashlib
import json
import random
from collections import Counter

import pytest

from quarry.llm import alignment
from quarry.llm.queries import tokenizer_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEADER = "doc_id bigint, text string, n_a string, run int"


def plain(texts):
    """The contract's columns, a byte at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_file(A))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(B))
    # The byte-level alphabet: printable bytes as they are, the others from 256 on in order.
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    alphabet = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    names = {i: t for t, i in json.load(open(tokenizer_file(A)))["model"]["vocab"].items()}
    spell_a = lambda i: bytes(alphabet[c] for c in names[i])

    def spell_b(i):
        p = two.IdToPiece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found = []
    for text in texts:
        a, b = [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            if not b"".join(map(spell_a, a)) == b"".join(map(spell_b, b)) == (" " + text).encode():
                a, b = [], []
        own_a = [k for k, i in enumerate(a) for _ in spell_a(i)]
        own_b = [k for k, i in enumerate(b) for _ in spell_b(i)]
        links = sorted(set(zip(own_a, own_b)))
        groups, at = [], 0
        for i in range(len(own_a)):
            if i + 1 == len(own_a) or (own_a[i] != own_a[i + 1] and own_b[i] != own_b[i + 1]):
                groups.append((sorted(set(own_a[at : i + 1])), sorted(set(own_b[at : i + 1]))))
                at = i + 1
        found.append((a, b, links, groups))
    count = Counter((a[x], b[y]) for a, b, links, _ in found for x, y in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    out = []
    for a, b, links, groups in found:
        shown = ";".join(",".join(str(a[x]) for x in g) + "|" + ",".join(str(b[y]) for y in h) for g, h in groups)
        many = [(count[a[x], b[y]], b[y]) for x, y in links]
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(shown.encode()).hexdigest() if a else "", sum(n == top[y] for n, y in many), sum(n for n, _ in many)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    odd = ["", None, " ", "  two  spaces ", "a▁b", "tab\tnew\nline", "éß漢字 \U0001f600!", "<|endoftext|> and </s> <s> <unk>", "<0x41>", "\x00\x1c\x85", "‍﻿", "café", "x" * 3000, "İĲﬁ", "12345 3.14 it's we'll"]
    made = [" ".join(rng.choice(["the", "tokenizer", "Donau", "quién", "zzxq", "über", "12", "!?", "Antidisestablishmentarianism"]) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    spaced = ["".join(rng.choice(["a", "B1", ".", "é", "漢", " ", " ", "  ", "\n", "\t ", "\xa0", "\x1c", "\x85 ", "\u3000", "'s", "-", "\u2581" * (rng.random() < 0.1)]) for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    return odd + made + made[:9] + spaced


@pytest.mark.parametrize("run_bytes", [1, 8 << 20])
def test_digest(spark, texts, run_bytes):
    rows = [(None if k == 3 else k, t, "clash", 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, HEADER).repartition(3)
    got = alignment.digest(docs, tokenizer_file(A), tokenizer_file(B), run_bytes)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    want = sorted((-1 if i is None else i, *x) for (i, *_), x in zip(rows, plain(texts)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert sum(x[1] == 0 for x in want) > 5 and sum(x[1] > 0 for x in want) > 150  # null, empty, and some that do not come back


def test_spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(2)
    want = plain(texts)
    for r in alignment.align(docs, tokenizer_file(A), tokenizer_file(B)).collect():
        shown = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(shown.encode()).hexdigest() if r.groups else "") == want[r.doc_id][4]
        assert len(r.links) == want[r.doc_id][3] == len({(x.a, x.b) for x in r.links})
        spans = [(g.first, g.last) for g in r.groups]
        size = len(f" {texts[r.doc_id]}".encode()) if r.groups else 0
        assert [x for a, b in spans for x in range(a, b + 1)] == list(range(size))


def test_none(spark):
    docs = spark.createDataFrame([], HEADER)
    assert alignment.digest(docs, tokenizer_file(A), tokenizer_file(B)).collect() == []
    docs = spark.createDataFrame([(1, None, None, 1), (1, "", None, 1)], HEADER)
    assert [tuple(r) for r in alignment.digest(docs, tokenizer_file(A), tokenizer_file(B)).collect()] == [(1, 0, 0, 0, 0, "", 0, 0)] * 2
