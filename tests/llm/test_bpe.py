"""BPE against the tokenizers library on awkward texts."""

import json
import time

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from millrace.llm import bpe

PATH = str(P.path("word_bpe_49k.json"))
TEXTS = [
    "", " \n\t ", "Hello, WORLD's 123 he'll it'S", "naïve café ÉCOLE straße ΑΣ Σ İstanbul", "a" * 3000, "ababababab" * 50, "!!!???...###$$$",
    "x<|endoftext|>y <|startoftext|>", "<|endoftext", "日本語テキスト 한국어 emoji 👍🏽 é Å", "a\x1cb\x1fc  d　e\xa0f​g", "1²½ Ⅳ ٣", "don't we've I'm you'd 'tis", "nul\x00l \x7f",
    "﻿bom", "mississippi " * 40, "zzzzzzzzzz" * 9, "e" * 777 + "'s" * 12,
]


def test_encode_and_decode_like_the_library(spark):
    t = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(5)
    texts = TEXTS + ["".join(rng.choice(list("abcdeéñ' \nTHE0!<|>"), 80)) for _ in range(300)]
    rows = spark.createDataFrame([(i, x, "k") for i, x in enumerate([*texts, None])], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(rows, PATH), PATH).collect()}
    assert len(got) == len(texts) + 1
    for i, x in enumerate([*texts, ""]):
        want = t.encode(x, add_special_tokens=False).ids
        assert got[i].ids == want, repr(x[:60])
        assert got[i].decoded == t.decode(want, skip_special_tokens=False)
    once = {r.doc_id: r.decoded for r in bpe.encode(rows, PATH, decoded=True).collect()}
    assert once == {i: r.decoded for i, r in got.items()}


def test_whole_table_against_the_library(spark):
    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in bpe.encode(docs, PATH).collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids


def test_long_words_against_the_library():
    t, v = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    rng = np.random.default_rng(3)
    of = lambda letters, n: "".join(rng.choice(list(letters), n))
    for word in ("a" * 4097, "ab" * 3000, of("ab", 5000), of("etaoinshr", 60_000), of("日本語é", 5000), "!" * 9000, "x " + "ha" * 5000 + " y " + "the" * 2000):
        ids, count = v.encode([word, "the end"])
        assert ids.tolist() == t.encode(word, add_special_tokens=False).ids + t.encode("the end", add_special_tokens=False).ids and count[1] == 2


def test_a_word_of_two_million_letters():
    t, v = Tokenizer.from_file(PATH), bpe.Vocabulary(PATH)
    word = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 2_000_000))
    began = time.time()
    ids, _ = v.encode([word])
    assert time.time() - began < 120
    assert ids.tolist() == t.encode(word, add_special_tokens=False).ids


def test_long_words_merge_one_by_one_where_a_merge_may_bring_a_lower_rank(monkeypatch):
    v = bpe.Vocabulary(PATH)
    word = "".join(np.random.default_rng(6).choice(list("etaoin"), 3000))
    want = v.encode([word])[0].tolist()
    monkeypatch.setattr(bpe, "LONG", 1000)
    for safe in (True, False):
        v.clear()
        v.safe[:] = safe
        assert v.encode([word])[0].tolist() == want


def test_other_files_are_refused(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": {**spec["model"], "end_of_word_suffix": None}}, {"model": {**spec["model"], "byte_fallback": True}}):
        (tmp_path / "f.json").write_text(json.dumps({**spec, **change}), encoding="utf-8")
        with pytest.raises(ValueError, match="other settings"):
            bpe.Vocabulary(str(tmp_path / "f.json"))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(none, PATH), PATH).collect() == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    v = bpe.Vocabulary(PATH)
    t = Tokenizer.from_file(PATH)
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(7))
        ids, count = v.encode([text, ""])
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and count.tolist() == [len(ids), 0]
    assert len(v.index) <= 10 + 7
