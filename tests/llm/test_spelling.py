"""Spelling variants against a plain version that compares all words, also with tiny blocks, and the query against a plain count."""

import random
import re
import zlib
from collections import Counter

from millrace.llm import queries, spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(n, times=5):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def check(spark, n, block):
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(map(tuple, spelling.group(words, block=block).collect())) == plain(n)


def made(rng, count, letters="abÀé"):
    n = {}
    while len(n) < count:
        w = "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 7, 8, 9])))
        n[w] = rng.choice([5, 5, 6, 25, 30, 125, 700, 4000])
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])
            if len(v) >= 6:
                n.setdefault(v, rng.choice([5, 6, 25, 130]))
    return n


def test_random_dictionaries_with_blocks_of_any_size(spark):
    rng = random.Random(13)
    n = made(rng, 250)
    for block in (3, 100_000):
        check(spark, n, block)
    check(spark, made(rng, 100, "abcdefghijklmnopqrstuvwxyz"), 1)


def test_one_prefix_and_one_suffix_for_all(spark):
    rng = random.Random(3)
    n = {f"aaaa{''.join(rng.choice('bcd') for _ in range(rng.choice([1, 2, 3])))}zzzz": rng.choice([5, 30, 200]) for _ in range(200)}
    check(spark, n, 4)


def test_each_pair_is_told_once(spark):
    n = {"abcdef": 5, "abcdeg": 6, "xbcdef": 7, "abxdef": 8, "abcxdef": 9, "abcdefx": 10, "xabcdef": 11, "aabcdef": 12, "aaaaaa": 5, "aaaaaaa": 26, "aaaaaaaa": 130}
    for block in (1, 50):
        check(spark, n, block)


def test_ties_chains_and_lone_words(spark):
    n = {"worbxs": 5, "words-": 1, "wordas": 25, "wordbs": 25, "wordxs": 5, "wardbs": 125, "wardbz": 625, "lonely": 9, "L" * 300 + "x": 5, "L" * 300 + "y": 50}
    check(spark, n, 128)


def test_empty_tables(spark):
    assert spelling.group(spark.createDataFrame([], "word string, n long")).collect() == []
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string, word string")).collect() == []


def plain_counts(rows, damage):
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if damage and h % damage == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            c[low] += 1
    return {w: k for w, k in c.items() if len(w) >= 6 and k >= 5}


def test_counts_of_odd_rows(spark):
    rows = [(None, "Señorita SEÑORITA señorita"), (None, "Señorita SEÑORITA señorita"), (1, None), (2, ""), (3, "señorita naïveté×naïveté"), (3, "señorita naïveté×naïveté")] + [(k, "Running,running9running") for k in range(40)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    for damage in (0, 3, 199):
        assert {r.word: r.n for r in spelling.vocabulary(df, damage=damage).collect()} == plain_counts(rows, damage)


def test_blocks_of_text_keep_runs_whole(monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 7)
    text = "one twothreefour, five " * 20 + "x" * 50 + " end"
    assert [w for own in spelling._runs(text) for w in own] == re.findall("[a-z]+", text)


def test_the_query_is_its_plain_version(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioulrst") for _ in range(rng.randrange(4, 9))) for _ in range(60)] + ["Straße", "ÉCLAIRS", "éclairs"]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(80)) + (" exemple" if k % 40 == 0 else " Example example")) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_spelling(spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = plain(plain_counts(rows, 199))
    assert sorted(map(tuple, got.collect())) == want and any(r[1] for r in want)
