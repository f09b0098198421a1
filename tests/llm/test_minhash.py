"""Near-duplicates against all pairs; components against union-find; large clusters against small ones."""

import inspect
import random
import re

import pyarrow as pa
import pytest

from millrace.llm import minhash
from millrace.llm import shingles as shingles_of
from millrace.llm.components import components, stars
from millrace.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(rows):
    rows = [(-(2**63) if i is None else i, shingles(t)) for i, t in rows]
    edges = [(i, j) for k, (i, a) in enumerate(rows) for j, b in rows[:k] if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    root = union_find({i for i, _ in rows}, edges)
    public = lambda i: None if i == -(2**63) else i
    return sorted(((public(i), len(s), public(root[i]), root[i] == i) for i, s in rows), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, cluster string")
    got = minhash.near_duplicates(df)
    assert {"n", "cluster", "text"} <= set(got.columns)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=str) == plain(rows)


def made(rng, n, group=1, vocabulary=3000):
    """Texts in families: each member has a few words of the family's text replaced."""
    out, i = [], 0
    while len(out) < n:
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, group + 1)):
            words = [w if rng.random() > rng.choice((0, 0.01, 0.03, 0.1)) else f"x{rng.randrange(vocabulary)}" for w in base]
            out.append((i * 7 % 100_003, " ".join(words) if rng.random() < 0.9 else "  " + "\n".join(words).upper()))
            i += 1
    return out[:n]


@pytest.mark.parametrize("limits", [(2000, 4_000_000, 4_000_000), (3, 4_000_000, 300)])
def test_against_all_pairs(spark, monkeypatch, limits):
    for name, v in zip(("CLUSTER_DOCS", "CLUSTER_SHINGLES", "PIVOT_SHINGLES"), limits, strict=True):
        monkeypatch.setattr(minhash, name, v)
    rng = random.Random(6)
    template = [f"t{k}" for k in range(60)]  # documents that share this much and are no near-duplicates
    check(spark, made(rng, 200, 12) + [(200_000 + i, " ".join(template + [f"own{i}-{k}" for k in range(rng.randrange(15, 60))])) for i in range(50)])


def test_rounds_without_an_order_of_the_cluster(spark, monkeypatch):
    """Many chained near copies and no room for a cluster in one task: rounds with few pivots find the links of all pairs, and no plan numbers a cluster's rows."""
    for name, v in (("CLUSTER_DOCS", 2), ("PIVOT_SHINGLES", 2_000), ("PIVOT_DOCS", 15), ("MORE_PIVOTS", 3)):
        monkeypatch.setattr(minhash, name, v)
    words = [f"w{k}" for k in range(400)]
    check(spark, [(i, " ".join(words[i : i + 60])) for i in range(0, 120, 3)] + [(1000 + i, " ".join(words[200:300] + [f"z{i}"] * (i % 3))) for i in range(60)])
    assert "row_number" not in inspect.getsource(minhash)


def test_templates_are_split(spark):
    """One cluster of a template with own endings and a few copies: only the copies stay together."""
    rows = [(1, i, sorted([*range(100), *range(1000 * (i // 2), 1000 * (i // 2) + 40), 10**6 + i])) for i in range(1, 21)]
    got = minhash.split_clusters(spark.createDataFrame(rows, "cluster long, _id long, shingles array<long>")).collect()
    assert sorted((r.cluster, r._id) for r in got) == sorted([(2 * (i // 2), i) for i in range(2, 20)])


def test_long_texts_in_blocks(spark, monkeypatch):
    """Sets of texts that are hashed in blocks, words over several of them included, equal those of whole texts."""
    rng = random.Random(3)
    texts = ["", "x" * 500, " " * 300, "a b c", *(" ".join("é" * rng.choice((1, 3, 90)) + str(rng.randrange(50)) for _ in range(rng.randrange(200))) + " " * rng.randrange(80) for _ in range(30))]
    want = [s.tolist() for s in shingle_sets(pa.array(texts))]
    for block in (7, 64, 250):
        monkeypatch.setattr(shingles_of, "BLOCK", block)
        assert [s.tolist() for s in shingle_sets(pa.array(texts))] == want


def test_odd_rows(spark):
    long = " ".join(f"t{k}" for k in range(40_000))
    check(spark, [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "A b"), (5, "a\tb"), (6, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"),
                  (8, "one two three four five six"), (9, long), (10, long + " end"), (11, "a\x1cb"), (11, "six seven eight nine ten"), (12, "six seven eight nine ten"), (13, "a\x1cb")])


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = union_find({n for e in edges for n in e}, edges)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "x long, y long")).collect() == []
    links = spark.createDataFrame([(max(e), min(e)) for e in edges if e[0] != e[1]], "_id long, low long")
    assert {r.node: r.root for r in components(stars(links)).collect()} == got
    near_copies = spark.createDataFrame([(i, t) for i in range(20, 120) for t in range(20)], "_id long, low long")
    assert stars(near_copies).count() == 119  # instead of 2000
