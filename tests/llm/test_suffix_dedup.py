"""Suffix sorting against sorted(); byte dedup against a set of all windows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import suffix_dedup as s
from millrace.llm.suffixes import suffix_order


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(500):
        text = [rng.randrange(1, rng.choice((2, 3, 5))) if rng.random() < 0.9 else 1 for _ in range(rng.randrange(70))]
        for depth in (3, 20, 100):
            order = suffix_order(np.array(text, np.int64), depth).tolist()
            cut = [text[i : i + depth] for i in order]
            assert sorted(order) == list(range(len(text))) and cut == sorted(cut)


def plain(rows):
    data = [(t or "").encode() for _, t in rows]
    seen = defaultdict(int)
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] += 1
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 1, bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        keep = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((i, len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(keep).hexdigest(), keep))
    return sorted(out, key=str)


def check(spark, rows):
    got = s.dedup_bytes(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, name string"))
    got = [(None if r._id == -(2**63) else r._id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got.collect()]
    assert sorted(got, key=str) == plain(rows)


def made(rng, n):
    letters = "abcdeé \n"
    passages = ["".join(rng.choice(letters) for _ in range(rng.choice((150, 199, 200, 201, 260, 600)))) for _ in range(6)]
    out = []
    for i in range(n):
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(250)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyz") + p[k + 1 :]
            parts += [p, "".join(rng.choice(letters) for _ in range(rng.randrange(90)))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("portion", [900_000, 5_000, 700])
def test_random_tables(spark, monkeypatch, portion):
    monkeypatch.setattr(s, "PORTION", portion)
    check(spark, made(random.Random(portion), 150))


def test_hot_names(spark, monkeypatch):
    """The ends of a passage that all documents share: its anchors' contexts outgrow portions and are refined, down to single windows."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, tails = word(700), [word(rng.choice((3, 40, 150))) for _ in range(40)]
    rows = [(i, word(rng.randrange(250)) + passage + rng.choice(tails) + word(rng.randrange(250))) for i in range(120)]
    levels = []
    refine = s._refine
    monkeypatch.setattr(s, "_refine", lambda level: levels.append(level) or refine(level))
    monkeypatch.setattr(s, "PORTION", 600)
    check(spark, rows)
    assert max(levels) >= 7


def test_halves_keep_every_window_once():
    data = bytes(np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8))
    parts, seen = [(150, 0, s.WIDTH, 0, data)], []
    while parts:
        o, a, b, lo, x = parts.pop()
        assert 0 <= b - a and x == data[lo : lo + len(x)] and b > o >= o - (len(x) - s.LENGTH) >= a
        if b - a == 1:
            assert len(x) == s.LENGTH
            seen.append(lo)
            continue
        for first, low, high, part, core in s.halves(o, a, b, x):
            assert core in part and len(core) == s.LENGTH - (high - 1 - low)
            parts.append((o - first, low, high, lo + first, part))
    assert sorted(seen) == list(range(101))


def test_neighbours_are_compared_by_bytes():
    data = np.frombuffer(b"a" * 200 + b"b" + b"a" * 200 + b"b" + b"a" * 199 + b"c", np.uint8)
    assert s.adjacent_equal(data, np.array([0, 201, 402])).tolist() == [True, False]
    assert s.adjacent_equal(data, np.array([0])).tolist() == [] and s.adjacent_equal(data[:0], np.array([], int)).tolist() == []


def test_odd_rows(spark):
    a = "".join(chr(97 + k % 23) for k in range(180)) + "tail of the first text here"
    check(spark, [(1, None), (2, ""), (3, "short"), (4, "z" * 200), (5, "z" * 201), (6, "y" * 1000), (None, a), (7, a), (8, "é" * 99 + "ab"), (8, "é" * 99 + "ab"), (9, "é" * 150)])
    check(spark, [(1, "only one text " * 3)])


def test_long_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 700)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef") for _ in range(3000))
    check(spark, [(1, text), (2, text[900:1700] + "x"), (3, text[:100] + text[2500:])])


def test_empty_table(spark):
    assert s.dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
