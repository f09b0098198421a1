"""The classifier on labels it has not seen, its pooling over slices, and odd tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import queries, toxicity
from millrace.llm.shared import Rolling, flat, mix


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_toxicity(spark, sf).join(labels, "doc_id").collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    bad, good = [r for r in test if r.toxic == 1], [r for r in test if r.toxic == 0]
    assert np.mean([r.predicted for r in bad]) >= 0.85 and np.mean([r.predicted for r in good]) <= 0.04
    scores = np.array([r.score for r in bad])[:, None] > np.array([r.score for r in good])[None, :]
    assert scores.mean() > 0.9


def made(spark, n=900):
    rng = random.Random(7)
    texts = []
    for i in range(n):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 60))]
        y = i % 4 == 0
        if y:
            words[rng.randrange(len(words))] = rng.choice(("vile", "awful"))
        texts.append((i, " ".join(words), rng.choice(("en", None)), int(y)))
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, toxic int")


def test_learns_and_slices_agree(spark, monkeypatch):
    df = made(spark)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    got = toxicity.score(df, model, lang_col="lang").where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.97
    texts = pa.array(["", "vile", " ".join(f"w{k}" for k in range(3000)) + " awful", "a b", "", "w1 vile w2"])
    w, p, c = toxicity.word_hashes(*flat(texts))
    whole = model.scores(model.rows(w), model.rows(p), c)
    for size in (2, 7, 100):
        monkeypatch.setattr(toxicity, "SLICE", size)
        assert np.allclose(model.scores(model.rows(w), model.rows(p), c), whole, atol=1e-5)


def plain_score(model, text):
    """One text through the network, word by word."""
    code = lambda b: int(toxicity._CODES[b])

    def hashed(piece, salt=0):
        h = sum(code(b) * pow(Rolling.BASE, k, 2**64) for k, b in enumerate(piece)) % 2**64
        return int(mix(np.array([h ^ salt], np.uint64))[0])

    known = {int(h): k + 1 for k, h in enumerate(model.known)}
    x = [model.table[known.get(hashed(w), 0)].astype(float) + model.table[known.get(hashed(w[:5], 0x5BD1E995), 0)].astype(float) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    z, col = model.shift, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            at = [sum(float(x[i + j] @ model.kernel[:, col + j * toxicity.FILTERS + f]) for j in range(width)) for i in range(len(x) - width + 1)]
            if at:
                n = k * toxicity.FILTERS + f
                z += max(0.0, max(at) + float(model.bias[n])) * float(model.weight[n])
        col += width * toxicity.FILTERS
    return 1 / (1 + math.exp(-(model.slope * (z - model.middle) + math.log(0.7 / 0.3))))


def test_scores_against_a_plain_network(spark, monkeypatch):
    df = made(spark)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    rows = [(i, t) for i, t in enumerate(["", None, "vile", "W1", "w1 VILE-w2", "awful é vile", "w3 " * 300 + "awfully", "no known words"])] + [(r.doc_id, r.text) for r in df.limit(60).collect()]
    for block in (40, toxicity.BLOCK):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        got = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect() if block > 40 else []
        w, p, c = toxicity.word_hashes(*flat(pa.array([t or "" for _, t in rows])), model.rows)
        assert np.allclose(model.scores(w, p, c), [plain_score(model, t or "") for _, t in rows], atol=1e-4)
        assert np.allclose(sorted(r.score for r in got), sorted(plain_score(model, t or "") for _, t in rows) if got else [], atol=1e-4)


def test_words_do_not_cross_texts():
    w, p, c = toxicity.word_hashes(*flat(pa.array(["ab", "cd e", "", "AB! é"])))
    assert c.tolist() == [1, 2, 0, 2] and w[0] == w[3] and len(set(w.tolist())) == 4


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "a", 5), (1, "b", 5)], "doc_id long, text string, score int")
    one = spark.createDataFrame([(1, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, one, lang_col=None)
    assert model is None
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 3 and all(r.score == 0 for r in rows)
    trained = toxicity.fit(df := made(spark), df.select("doc_id", "toxic"))
    assert len(toxicity.score(docs, trained).collect()) == 3
    assert toxicity.score(docs.where("false"), trained).collect() == []
    assert docs.select(toxicity.held_out().alias("h")).where(F.col("h").isNull()).count() == 0


def test_learns_rare_words_from_many_labels():
    rng = random.Random(9)
    texts, y = [], []
    for i in range(2400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 30))]
        if i % 2:
            words[0] = "grobian" if i % 200 == 1 else rng.choice(("vile", "awful"))  # the first in 1 % of the toxic texts
        texts.append(" ".join(words))
        y.append(i % 2)
    model = toxicity.train(*toxicity.word_hashes(*flat(pa.array(texts))), np.array(y, np.float32))
    w, p, c = toxicity.word_hashes(*flat(pa.array(["w1 w2 grobian w3", "w1 w2 w4 w3"])))
    assert (model.rows(w[2:3]) > 0).all()
    with_it, without = model.logits(model.rows(w), model.rows(p), c)
    assert with_it > 0 > without


def test_trains_on_very_long_texts(spark, monkeypatch):
    long = F.concat(F.repeat(F.lit("word "), 41_000), F.when(F.col("id") % 2 == 0, F.lit("vile")).otherwise(F.lit("kind")))
    docs = spark.range(60).select(F.col("id").alias("doc_id"), long.alias("text"), (F.col("id") % 2 == 0).cast("int").alias("toxic"))
    assert docs.where("length(text) <= 200000").count() == 0
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), lang_col=None)
    assert all((r.score >= 0.7) == (r.toxic == 1) for r in toxicity.score(docs, model).select("score", "toxic").collect())
    w, p, c = toxicity.word_hashes(*flat(pa.array(["a b", " ".join(f"word vile{k} kind" for k in range(90)) + " vile", "", "vile kind"])))
    rng = np.random.default_rng(1)
    model.known, model.table = np.unique(w), rng.normal(size=(len(np.unique(w)) + 1, toxicity.DIM)).astype(np.float32)
    whole, places = model.pooled(model.rows(w), model.rows(p), c, where=True)
    for size in (3, 7, 100):
        monkeypatch.setattr(toxicity, "SLICE", size)
        top, at = model.pooled(model.rows(w), model.rows(p), c, where=True)
        assert np.allclose(top, whole, atol=1e-5) and (at[np.isfinite(top)] == places[np.isfinite(top)]).all()


def test_training_is_bounded_in_words(spark, monkeypatch):
    """Texts over an eighth of the bound aren't learned from, repeated rows once; what is left is as before."""
    df = made(spark)
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    again = toxicity.fit(df.union(df), df.select("doc_id", "toxic").union(df.select("doc_id", "toxic")))
    assert (again.known == model.known).all() and np.allclose(again.table, model.table)
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 30_000)
    huge = spark.createDataFrame([(10_000 + k, "vile " * 4000, "en", 0) for k in range(30)], df.schema)
    more = df.union(huge)
    bounded = toxicity.fit(more, more.select("doc_id", "toxic"))
    assert (bounded.known == model.known).all() and np.allclose(bounded.table, model.table)
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 3_000)
    fewer = toxicity.fit(df, df.select("doc_id", "toxic"))
    assert fewer is not None and len(fewer.known) < len(model.known)


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """Words of three texts each, over more rows than one block has: all of them are known, and how the table is dealt makes no difference."""
    monkeypatch.setattr(toxicity, "SHARE", 1000)
    n, rng = 12_000, random.Random(3)
    learned = [i for i in range(n) if zlib.crc32(str(i).encode()) % 3 != 1]
    place = {i: k for k, i in enumerate(learned)}
    rows = [(i, f"g{place.get(i, 0) // 15} " + " ".join(f"w{rng.randrange(300)}" for _ in range(6)) + (" vile" if i % 4 == 0 else " kind"), "en", int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"))
    w, _, _ = toxicity.word_hashes(*flat(pa.array([f"g{k}" for k in range(len(learned) // 15)])))
    assert np.isin(w, model.known).mean() > 0.999  # fifteen texts each, of which a fifth is kept for calibration
    got = toxicity.score(docs, model).where(toxicity.held_out()).collect()
    assert np.mean([(r.score >= 0.7) == (r.toxic == 1) for r in got]) > 0.99
    again = toxicity.fit(docs.repartition(7, "text"), docs.select("doc_id", "toxic").repartition(3))
    assert (again.known == model.known).all() and (again.table == model.table).all() and again.thresholds == model.thresholds and again.middle == model.middle


def test_thresholds_from_counts():
    z = np.array([-2.0, -1.0, 3.0, 4.0, 4.0, -1.0])
    assert toxicity._best_cut(*toxicity._summed(z, np.array([0, 0, 1, 5, 2, 0]), np.array([9, 3, 0, 0, 0, 4]))) == 1.0
    assert toxicity._middle(np.array([1.0, 2.0, 5.0]), np.array([1, 0, 1])) == 3.0 and toxicity._middle(np.array([1.0, 2.0, 5.0]), np.array([1, 1, 5])) == 5.0
