"""The pipeline stage by stage on a small table, each against a plain version of its own."""

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import quality_rules
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_minhash import plain as plain_groups
from tests.llm.test_mixing import plain as plain_mixture
from tests.llm.test_quality_rules import plain as plain_stats

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, docs, SF).cache()
    assert good.columns == names
    rules = quality_rules.learn(quality_rules.labelled(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    judged = {r.doc_id: r.rule for r in quality_rules.judge(docs, rules).collect()}
    want = {r.doc_id for r in docs.collect() if not plain_stats(r.text)[5] and judged[r.doc_id] == 0}
    assert {r.doc_id for r in good.collect()} == want and len(want) > 0.5 * docs.count()

    rows = [(r.doc_id, r.text) for r in good.collect()]
    fewer = stages["line dedup"](spark, good, SF).cache()
    assert fewer.columns == names
    assert sorted((r.doc_id, r.text, r.n_chars) for r in fewer.collect()) == sorted((i, t, len(t)) for i, _, _, t in plain_lines(rows))

    rows = [(r.doc_id, r.text) for r in fewer.collect()]
    single = stages["near-duplicates"](spark, fewer, SF).cache()
    assert single.columns == names
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, _, _, kept in plain_groups(rows) if kept)

    rows = [(r.doc_id, f"d{int(r.source[3:]) % 4}", r.lang, r.source, len(r.text.split())) for r in single.collect()]
    mixed = stages["mixing"](spark, single, SF).cache()
    assert mixed.columns == names
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, _ in plain_mixture(rows, corpus_pipeline.WEIGHTS, (1, 1), 4, 17))

    t = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text for r in single.collect()}
    got = stages["encoding"](spark, mixed, SF).collect()
    assert len(got) == mixed.count()
    for r in got:
        assert r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_odd_rows_and_clashing_names(spark):
    long = " ".join(f"word{k}" for k in range(30_000))
    text = " ".join(f"w{k % 97}x{k}" for k in range(80))
    rows = [(1, text, "en", "src1", 5), (1, text, "en", "src1", 5), (2, text + " more", None, None, None), (3, None, "en", "src0", 0), (None, text + "\n" + text, "de", "other", 1), (5, "", "fr", "src3", 0), (6, long, "en", "src2", 9)]
    extra = ["kept", "rule", "kept_text", "component_id", "epoch", "domain", "_id", "_row", "ids"]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in extra)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    seen = {(r.doc_id, r.ids) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), after.schema)
        assert {(r.doc_id, r.ids) for r in docs.collect()} <= seen
        assert all(r[c][: len(c)] == c for r in docs.collect() for c in extra)
    assert {r.doc_id for r in docs.collect()} <= {1, 2, None, 6} and docs.count() > 0
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(got) == docs.count() and all(r.n_tokens == len(r.ids) > 0 for r in got)
