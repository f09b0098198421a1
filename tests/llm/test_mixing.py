"""Budgets against a plain recursion, prefixes against a sort, on random trees."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def shared_out(kids, budget):
    """kids: {name: (cap, weight)}; capped shares by weight, in exact arithmetic."""
    out, left, open_ = {}, budget, {k: v for k, v in kids.items() if v[1] > 0}
    while open_:
        w = sum(x[1] for x in open_.values())
        full = {k: v for k, v in open_.items() if v[0] * w <= left * v[1]}
        if not full:
            return out | {k: left * v[1] // w for k, v in open_.items()}
        k = min(full, key=lambda k: (Fraction(full[k][0], full[k][1]), k))
        out[k] = full[k][0]
        left -= full[k][0]
        del open_[k]
    return out


def plain(rows, weights, share, epochs, seed):
    def weight(*path):
        for p in (path, ("*",) * (len(path) - 1) + path[-1:]):
            if p in weights:
                return weights[p]
        return 1

    leaf = defaultdict(list)
    for i, d, l, s, t in rows:
        leaf[d, l or "", s or ""].append((i, t or 0))
    tokens = {k: sum(t for _, t in v) for k, v in leaf.items()}
    cap = {k: v * epochs for k, v in tokens.items()}

    def capacity(path):
        if len(path) == 3:
            return cap[path]
        kids = {k[: len(path) + 1] for k in cap if k[: len(path)] == path}
        return sum(capacity(k) for k in kids if weight(*k) > 0)

    budget = {(): min(sum(tokens.values()) * share[0] // share[1], capacity(()))}
    for level in range(3):
        for path in [p for p in budget if len(p) == level]:
            kids = {k[: level + 1] for k in cap if k[:level] == path}
            budget |= shared_out({k: (capacity(k), weight(*k)) for k in kids}, budget[path])
    out = []
    for k, docs in leaf.items():
        if k not in budget:
            continue
        n = budget[k] // tokens[k] if tokens[k] else 0
        rest = budget[k] - n * tokens[k]
        key = lambda i: hashlib.md5(f"{seed}:{n}:{'null' if i is None else i}".encode()).hexdigest()  # noqa: E731, B023
        by = defaultdict(list)
        for i, t in docs:
            by[key(i)].append((i, t))
        total, fits = 0, True
        for h in sorted(by):
            total += sum(t for _, t in by[h])
            fits = fits and total <= rest
            for i, _ in by[h]:
                out += [(i, e) for e in range(n + fits)]
    return sorted(out, key=str)


@pytest.mark.parametrize("case", range(5))
def test_random_trees(spark, case):
    rng = random.Random(case)
    n = (0, 1, 60, 400, 800)[case]
    rows = []
    for k in range(n):
        s = "s0" if rng.random() < 0.4 else rng.choice(["s1", "s2", "s3", None])
        rows.append((rng.choice([k, k, None, 7]), rng.choice("abc"), rng.choice(["en", "de", None]), s, rng.choice([0, None, 1, 5, rng.randrange(1, 4000)])))
    weights = {("a",): 5, ("b",): 1, ("*", "en"): 3, ("a", "de"): 0, ("*", "*", "s0"): 1, ("*", "*", "s1"): 4}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, dom string, lang string, source string, n long, epoch string, tokens int")
    share, epochs = rng.choice([(1, 3), (1, 1), (5, 2), (40, 1)]), rng.choice([1, 3])
    got = mixing.mix_sources(df, F.col("dom"), weights, share, epochs, 3, tokens=F.col("n"))
    assert {"dom", "n", "tokens"} <= set(got.columns)
    assert sorted(((r.doc_id, r.epoch) for r in got.collect()), key=str) == plain(rows, weights, share, epochs, 3)
