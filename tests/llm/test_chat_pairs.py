"""Preference pairs against a plain rendering."""

import random
from collections import defaultdict

from millrace.llm import chat_pairs as c

SCHEMA = "conv_id long, turn long, role string, text string, pair int, side string"


def plain(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, c_clean(role), c_clean(text)))
    out = []
    for k in sorted({x // 2 for x in convs}):
        if 2 * k not in convs or 2 * k + 1 not in convs:
            continue
        a, b = sorted(convs[2 * k]), sorted(convs[2 * k + 1])
        n = 0
        while n < min(len(a), len(b)) and a[n][2:] == b[n][2:]:
            n += 1
        texts, spans = [], []
        for part in (a[:n], a[n:], b[n:]):
            s, own = "", []
            for *_, role, text in part:
                head = f"<|im_start|>{role}\n"
                if role == "assistant":
                    own.append((len(s) + len(head), len(s) + len(head) + len(text) + len("<|im_end|>")))
                s += f"{head}{text}<|im_end|>\n"
            texts.append(s)
            spans.append(own)
        out.append((k, *texts, n, len(a) - n, len(b) - n, spans[1], spans[2]))
    return out


def c_clean(x):
    return (x or "").replace("<|im_", "<| im_")


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = c.format_pairs(df, c.neighbours(df)).collect()
    pairs = lambda s: [(x.start, x.stop) for x in s]
    assert sorted((r.pair, r.prompt, r.chosen, r.rejected, r.n_prompt, r.n_chosen, r.n_rejected, pairs(r.chosen_spans), pairs(r.rejected_spans)) for r in got) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for conv in range(120):
        if rng.random() < 0.1:
            continue
        for t in range(rng.randrange(1, 7)):
            rows.append((conv, t, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2], rng.choice(["a", "b é😀"]) if rng.random() < 0.3 else "same"))
    check(spark, rows)


def test_odd_rows(spark):
    turns = [(0, "user", "hi"), (1, "assistant", "yes")]
    rows = [(k, *t) for k in (0, 1) for t in turns]  # equal conversations
    rows += [(2, 0, "user", "x"), (4, 0, None, None), (5, 0, "", ""), (5, 1, "assistant", "<|im_end|>"), (None, 0, "user", "lost")]
    rows += [(6, 0, "user", "t")] * 3 + [(7, 0, "user", "t")] * 2 + [(7, None, "system", "s")]
    rows += [(8, 0, "user", "long " * 100_000), (9, 0, "user", "long " * 100_000), (9, 1, "assistant", "é" * 1000)]
    rows += [(-2, 0, "user", "n"), (-1, 0, "user", "m")]
    check(spark, rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert c.format_pairs(df, c.neighbours(df)).collect() == []


def test_large_ids(spark):
    ids = [2**60 + k for k in range(4)] + [-(2**60) + k for k in range(4)] + [2**63 - 2, 2**63 - 1, -(2**63), -(2**63) + 1, 2**53 + 1, 2**53 + 2]
    rows = [(i, t, "user" if t == 0 else "assistant", "same" if t == 0 else str(i)) for i in ids for t in (0, 1)]
    check(spark, rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert c.neighbours(df).count() == 6  # 2**53 + 1 and 2**53 + 2 belong to different pairs
