"""Fingerprints against a plain parse, and the chain of successors against a sorted list."""

import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import lz_fingerprint as z


def plain_phrases(text, most=10**9):
    seen, out, p = set(), [], ""
    for c in text:
        p += c
        if p not in seen:
            seen.add(p)
            out.append(p)
            p = ""
            if len(seen) == most:
                seen = set()
    return out + ([p] if p else [])


def test_parse_and_pair():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(60)))
        b = "".join(rng.choice("abé") for _ in range(rng.randrange(60)))
        e = z.edit(a, b)
        ends, edited = z.parse_pair(a, e, len(a) - len(a) // 2)
        for t, got in ((a, ends), (e, edited)):
            assert [t[i:j] for i, j in zip([0, *got[:-1]], got, strict=False)] == plain_phrases(t)
            assert got == z.phrase_ends(t)
        assert (z.signature(a, ends) == z.signature(a + "", z.phrase_ends(a))).all()


def test_long_texts_use_bounded_dictionaries_and_blocks(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(400))) for _ in range(40)]
    whole = [z.signature(t, z.phrase_ends(t)) for t in texts]
    for block in (1, 5, 90):
        monkeypatch.setattr(z, "BLOCK", block)
        assert all((z.signature(t, z.phrase_ends(t)) == w).all() for t, w in zip(texts, whole, strict=True))
    monkeypatch.setattr(z, "MOST", 7)
    for t, n in zip(texts, texts[1:], strict=False):
        e = z.edit(t, n)
        for x, got in zip((t, e), z.parse_pair(t, e, len(t) - len(t) // 2), strict=True):
            assert [x[i:j] for i, j in zip([0, *got[:-1]], got, strict=False)] == plain_phrases(x, 7) and got == z.phrase_ends(x)


def test_likeness_follows_phrase_sets():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    for share in (0.2, 0.6, 0.95):
        a = " ".join(rng.choice(words) for _ in range(1500))
        cut = int(len(a) * share)
        b = a[:cut] + " ".join(rng.choice(words) for _ in range(1500))[: len(a) - cut]
        pa, pb = set(plain_phrases(a)), set(plain_phrases(b))
        got = z.likeness(z.signature(a, z.phrase_ends(a)), z.signature(b, z.phrase_ends(b)))
        assert abs(got - len(pa & pb) / len(pa | pb)) < 0.2
    assert z.likeness(z.EMPTY, z.EMPTY) == 1 and z.likeness(z.EMPTY, z.signature("abc", z.phrase_ends("abc"))) == 0


def check(spark, rows, parts):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, edited int")
    got = sorted(((r._id, r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in z.compare_next(df, parts=parts).collect()))
    hashed = df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = [(i, t) for i, _, t in sorted((-(2**63) if r.doc_id is None else r.doc_id, r.h, r.text or "") for r in hashed)]
    sig = lambda t: z.signature(t, z.phrase_ends(t))
    want = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i, len(t), e, z.to_hex(sig(t)), z.to_hex(sig(e)), float(np.mean(sig(t) == sig(e))), float(np.mean(sig(t) == sig(n)))))
    assert got == sorted(want)


def test_successors(spark):
    rng = random.Random(9)
    text = lambda: "".join(rng.choice("ab c") for _ in range(rng.randrange(50)))
    ids = rng.sample(range(10**6), 200)
    for parts in (1, 5, 37):
        check(spark, [(i, text()) for i in ids], parts)
    check(spark, [(7, "only one")], 5)
    check(spark, [(1, None), (2, ""), (None, "x"), (None, "y"), (3, "same"), (3, "same"), (3, "other"), (4, "long " * 50_000)], 3)
    check(spark, [(5, text()) for _ in range(50)], 8)


def test_empty_table_and_plain_fingerprint(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert z.compare_next(none).collect() == [] and z.fingerprint(none).collect() == []
    got = z.fingerprint(spark.createDataFrame([("a b a b", 1), (None, 2), ("a b a b", 3)], "text string, fingerprint int")).collect()
    assert got[0].fingerprint == got[2].fingerprint == z.to_hex(z.signature("a b a b", z.phrase_ends("a b a b"))) and got[1].fingerprint == z.to_hex(z.EMPTY)


def test_hot_ids_are_cut_by_hash(spark):
    """A third of all rows without an id: they spread over several ranges and stay one chain."""
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else k, "".join(rng.choice("abc ") for _ in range(rng.randrange(40)))) for k in range(240)]
    check(spark, rows, 12)
    bounds = z.ranges(z.keyed(spark.createDataFrame(rows, "doc_id long, text string")).select("_id"), 12)
    assert sum(i == -(2**63) for i, _ in bounds) >= 3 and len(set(bounds)) == len(bounds)
