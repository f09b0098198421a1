"""Runs against a plain search of every lag, and the query against a plain version of its digest."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from millrace.llm import periodic_runs, queries


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def check(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, runs string, _row int")
    got = periodic_runs.find_runs(df)
    assert got.columns == ["doc_id", "text", "_row", "n_words", "runs", "collapsed"]
    rows = got.orderBy("doc_id").collect()
    for r, digest, text in zip(rows, periodic_runs.run_digests(df).orderBy("doc_id").collect(), texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), runs, collapsed(w, runs))
        assert (digest.n_words, digest.runs, digest.collapsed_sha256) == (r.n_words, r.runs, hashlib.sha256(r.collapsed.encode()).hexdigest())


def made(rng, parts):
    """Text of few words with repeated stretches, some of them interrupted."""
    out = []
    for _ in range(parts):
        if rng.random() < 0.5:
            out += [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        else:
            stretch = [rng.choice("abc") for _ in range(rng.randrange(1, 25))]
            out += (stretch * 12)[: rng.randrange(24, 150)]
    return out


def test_random_texts(spark):
    rng = random.Random(12)
    check(spark, [" ".join(made(rng, rng.randrange(6))) for _ in range(150)])


def test_odd_texts(spark):
    stretch = "é ü x ß"
    check(spark, [None, "", " \t\n\x0b\x0c\r", "a " * 23, "a " * 24, "a " * 25, "\n".join([stretch] * 8), "\n".join([stretch] * 7), "b " + "a " * 30 + "b " + "a " * 30, "a " * 24, "A a " * 20])
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_frequent_words_are_counted_by_fft(spark):
    rng = random.Random(4)
    words = [rng.choice(["the", "of", *map(str, range(50))]) if rng.random() < 0.6 else "the" for _ in range(9000)]
    words[3000:4000] = (words[3000:3130] * 9)[:1000]
    words[5000:8900] = (words[5000:5900] * 5)[:3900]
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    counts, _ = periodic_runs.lag_counts(codes, np.array([0, len(codes)]))
    assert np.bincount(codes).max() > periodic_runs._heavy(len(codes))
    assert counts.tolist() == [int((codes[:-q] == codes[q:]).sum()) for q in range(1, len(codes) // 3 + 1)]
    assert periodic_runs.runs_of(codes, counts) == plain_runs(words)
    check(spark, [" ".join(words), "x y z", " ".join(words[2500:])])


def test_texts_of_a_batch_do_not_mix():
    codes, offs = np.array([0, 1, 0, 1, 0, 1, 2, 2, 2, 2, 2, 2, 2]), np.array([0, 6, 6, 13])
    counts, base = periodic_runs.lag_counts(codes, offs)
    assert base.tolist() == [0, 2, 2, 4] and counts.tolist() == [0, 4, 6, 5]


def test_very_long_texts():
    began = time.time()
    for words in (np.zeros(300_000, np.int64), np.resize(np.arange(40_000), 300_000), np.random.default_rng(1).zipf(1.3, 300_000) % 5000):
        counts, _ = periodic_runs.lag_counts(words, np.array([0, len(words)]))
        runs = periodic_runs.runs_of(words, counts)
        assert [r for r in runs if r[1] > 10_000] == ([] if len(runs) != 1 else [(0, 300_000, 1 if words[1] == 0 else 40_000)])
    assert time.time() - began < 60
    text = b"word " * 3 + b"x" * (3 << 20) + b" tail \xc3\xa9"
    codes, known = periodic_runs._words(memoryview(text))
    assert codes.tolist() == [0, 0, 0, 1, 2, 3] and [len(k) for k in known] == [4, 3 << 20, 4, 2]


def test_the_query_is_its_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " \n".join(made(rng, rng.randrange(5)))) for k in range(120)] + [(200, None), (201, " "), (202, ""), (203, "one")] + [(k, "w%d " % k * 5) for k in range(300, 340)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in runs), collapsed(w, runs))]
        want.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)
