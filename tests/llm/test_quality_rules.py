"""Statistics against a plain version; learned lists against labels held out."""

import random
import re

from millrace.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), base


def test_statistics_like_the_plain_version(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "a b c", "a b c a b c", "a a a a a a", "x\ny\nx\n \n \n", "é\x85ü b", "😀 # 😀 #|<", "word " * 30_000, "a\x0bb\x1cc"]
    texts += ["".join(rng.choice("ab \n#é") for _ in range(rng.randrange(300))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: r for r in q.judge(df, []).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(t), repr(t)
        assert r.kept == (not r.base_failed)


def test_whole_table_and_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rules = q.learn(q.labelled(docs, train))
    assert rules
    rows = q.judge(docs, rules).join(test, "doc_id").collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(r.text)
    judged = [r for r in rows if not r.base_failed]
    good = [r for r in judged if r.quality == 1]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.7 * len(bad)


def test_no_usable_labels(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.learn(q.labelled(df, none)) == []
    assert q.learn([dict.fromkeys(q.FEATURES, 1.0) | {"bad": True}] * 20) == []
    assert q.judge(spark.createDataFrame([], "doc_id long, text string"), []).collect() == []


def test_learned_list_is_ordered_and_pruned():
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        r = {f: rng.random() for f in q.FEATURES}
        rows.append(r | {"bad": r["symbol_share"] > 0.8 or (r["upper_share"] > 0.7 and r["n_words"] < 0.3)})
    rules = q.learn(rows)
    wrong = sum(any(q._covers(rule, r) for rule in rules) != r["bad"] for r in rows)
    assert len(rules) >= 2 and all(len(x) <= 4 for x in rules) and wrong < 30
