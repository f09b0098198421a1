"""Decontamination against a plain version that compares every window with every other."""

import random
import re

import pytest

from millrace.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, n_hit string, _id int", "item_id long, text string, window string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        m = min(len(w), 10)
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for s in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[s : s + m]))) is not None:
                    hit.update(range(s, s + m))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    got = decontaminate.decontaminate(d, b)
    assert got.columns == ["doc_id", "text", "_id", "n_words", "n_hit", "spans", "items"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str) == plain(docs, items)
    for r in rows:
        spans = [(s.start, s.stop) for s in r.spans]
        assert r.n_hit == sum(b - a for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_random_tables(spark):
    rng = random.Random(11)
    vocabulary = ["the", "of", "Ünder", "río", "x1", "99", "and", "WORD", "so"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 4, 6, 9, 10, 11, 25]) if k > 3 else 30)) for k in range(12)]
    items = [(k, t) for k, t in items if len(t.split()) > 3]
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    docs += [(100 + k, f"{text(20)}, {rng.choice(items)[1].upper()}!? {text(20)}") for k in range(30)]
    check(spark, docs, items)


def test_windows_of_ten_and_no_less(spark):
    item = [f"w{k}" for k in range(14)]
    docs = [(k, " ".join(["own", *item[:k], "words"])) for k in range(15)]
    check(spark, docs, [(5, " ".join(item))])


def test_odd_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(None, passage), (None, passage), (1, None), (2, ""), (3, "?! ,"), (4, passage), (4, passage), (4, "other"), (5, passage.replace(" ", "\x00\n- "))]
    check(spark, docs, [(7, passage), (7, passage), (None, passage + " twelve"), (8, None), (9, ""), (10, "--")])
    check(spark, docs, [])
    check(spark, [], [(7, passage)])


def test_short_items_of_all_lengths(spark):
    check(spark, [(k, "a b c d e f g h i j k l " * 2) for k in range(3)], [(n, " ".join("abcdefghijkl"[:n])) for n in range(1, 13)])


def test_blocks_of_long_texts(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(10))) for k in range(20)]
    long = " ".join(rng.choice(items)[1] if rng.random() < 0.2 else "".join(rng.choice("abcdefgh") * rng.choice([1, 1, 1, 40])) for _ in range(3000))
    monkeypatch.setattr(decontaminate, "BLOCK", 300)
    import numpy as np

    from millrace.llm.decontaminate import _windows

    for text in (long, "z" * 5000 + " " + items[0][1] + " " + "y" * 4000, items[1][1] + " " + "x" * 999):
        data = np.frombuffer(text.encode(), np.uint8)
        total, found = 0, set()
        for _, new, rows in _windows(data, np.array([0, len(data)]), [10], None, False):
            total += int(new.sum())
            found |= {(at, window) for _, at, _, _, _, window in rows}
        w = words(text)
        assert total == len(w)
        assert found == {(s, " ".join(w[s : s + 10])) for s in range(len(w) - 9)}


def test_a_passage_in_every_document_and_every_item(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    check(spark, [(k, f"own{k} {passage}") for k in range(300)], [(k, f"{passage} q{k}") for k in range(40)])


def test_fingerprints_of_equal_windows_are_equal():
    import numpy as np

    words_of = np.random.default_rng(0).integers(0, 5, 4000).astype(np.uint64)
    for size in (1, 4, 5, 6, 10):
        prints, seen = decontaminate.fingerprints(words_of, size), {}
        for s, p in enumerate(prints.tolist()):
            assert seen.setdefault(tuple(words_of[s : s + size].tolist()), p) == p


@pytest.mark.parametrize("n", [0, 3, 9])
def test_texts_shorter_than_a_window(n):
    import numpy as np

    assert len(decontaminate.fingerprints(np.arange(n, dtype=np.uint64), 10)) == 0
