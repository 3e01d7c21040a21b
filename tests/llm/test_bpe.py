"""The automaton against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm.bpe import Automaton, decode, digest, encode

FILE = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", " ", "a", "'s don't we'll I'd", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|><|", "aaaaaaaaaaaaaaa", "Straße ÉÈ é İ ΑΣ Σ", "a\x1cb\x85c d e", "123 4५6", "漢字かな한국어", "!!!???...<|>", "🙂🙂 zero​width", "\t\n\r\x0b\x0c", "A" * 3000, "</w> a</w>", "don’t", "a\x00b\x1fc"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text_match_the_library(library):
    a = Automaton(FILE).ready()
    a.label.update({i: t for t, i in a.special.items()})
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("thean ing ouéß'd.\n1<|>") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert a.encode(t) == ids, t
        ((n, shown, text),) = a.digest([t])
        assert (n, shown) == (len(ids), " ".join(map(str, ids))), t
        assert text == library.decode(ids, skip_special_tokens=False), t


def test_every_token_is_its_own_encoding_or_split(library):
    a = Automaton(FILE).ready()
    rng = random.Random(5)
    for i in rng.sample(sorted(a.label), 3000):
        word = a.label[i].removesuffix("</w>")
        assert a.encode(word) == library.encode(word, add_special_tokens=False).ids, word


def test_frames(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, None, None), (1, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted(map(tuple, digest(docs, FILE).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert digest(docs.limit(0), FILE).collect() == []
    back = {r.doc_id: r.decoded for r in decode(encode(docs.where("doc_id > 2"), FILE), FILE).collect()}
    assert back[6] == library.decode(library.encode(ODD[6], add_special_tokens=False).ids, skip_special_tokens=False)


def test_two_tokenizers_of_one_size_in_one_worker(tmp_path):
    """A worker that has met one tokenizer does not encode with it for another."""
    import json
    from types import SimpleNamespace

    from quarry.llm import bpe

    spec = json.load(open(FILE))
    vocab = spec["model"]["vocab"]
    vocab["the</w>"], vocab["and</w>"] = vocab["and</w>"], vocab["the</w>"]
    (tmp_path / "other.json").write_text(json.dumps(spec))
    one, two = Automaton(FILE), Automaton(str(tmp_path / "other.json"))
    first = bpe._worker(SimpleNamespace(value=one)).encode("the and")
    second = bpe._worker(SimpleNamespace(value=two)).encode("the and")
    assert first == second[::-1] != second
    assert bpe._worker(SimpleNamespace(value=one)).encode("the and") == first
