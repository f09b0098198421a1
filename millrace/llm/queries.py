"""The queries op1_ to op13_ and pipeline: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_pairs, decontaminate, line_dedup, lz_fingerprint, minhash, mixing, periodic_runs, quality_rules, spelling, suffix_dedup, toxicity, url_filter
from .shared import public_id, written

Query = Callable[[SparkSession, str], DataFrame]


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``; Python workers are told where this package is, for sessions started elsewhere."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), ROOT) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(public_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Target weights of the mixture; domains are groups of sources.
WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d3",): 1, ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 1}


def domain() -> Column:
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int") % 4, F.lit(0)).cast("string"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix_sources(docs, domain(), WEIGHTS, share=(3, 5)).select("doc_id", "epoch", "place", "domain", "lang", "source")


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_fingerprint.compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(public_id().alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, lang_col="lang")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.DECIDE).cast("int").alias("predicted"), "flagged")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", url_filter.page_kind(F.col("html")).alias("page_kind"))
    found = url_filter.judge(written(pages, "page-kinds"), page=F.col("page_kind"))  # written, so that every page is read once
    return found.select("page_id", "host", "path", "rule", "score", "verdict")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = chat_pairs.format_pairs(turns, chat_pairs.neighbours(turns))
    hashed = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    counted = [F.aggregate(f"{c}_spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"]).alias(f"{c}_counted") for c in ("chosen", "rejected")]
    return found.select(F.col("pair").cast("long").alias("pair_id"), "n_prompt", "n_chosen", "n_rejected", *hashed, *counted)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(quality_rules.labelled(docs, table(spark, sf_dir, "labels")))
    return quality_rules.judge(docs, rules).select("doc_id", *quality_rules.STATS, "base_failed", "kept")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.labels(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(public_id().alias("doc_id"), "n_shingles", public_id("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select(public_id().alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, (F.col("n_hit") > 0).alias("contaminated"))


def tail_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text): from a word on that the id's crc32 tells, one text in ten repeats a stretch of its words to its end; such a text is given as its words joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    drawn = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    cut = drawn.select("doc_id", "text", "g", words.alias("words")).select("*", F.size("words").cast("long").alias("n")).select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).alias("a"))
    cut = cut.select("doc_id", "text", "words", "n", "a", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    a, p = F.col("a").cast("int"), F.col("p").cast("int")
    left = F.col("n").cast("int") - a
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), F.ceil(left / p).cast("int"))), F.lit(1), left)
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.run_digests(tail_repeated(docs))
    # (length, period) a and b compared by length_a * period_b and length_b * period_a, exactly; runs come by start and period, and the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    told = found.select("*", best.alias("best"), F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "").alias("listed"))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2("listed", 256).alias("runs_sha256"), "collapsed_sha256",
    )


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"), damage=199)


_OPS = (
    op1_suffix_dedup, op2_line_dedup, op3_mixing, op4_lz_fingerprint, op5_toxicity, op6_url_filter, op7_bpe, op8_chat_pairs, op9_quality_rules, op10_minhash, op11_decontaminate, op12_periodic_runs, op13_spelling,
)
QUERIES: dict[str, Query] = {f.__name__: f for f in _OPS}

ORACLE_SQL: dict[str, str] = {
    "op11_decontaminate": r"""
WITH lowered AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
told AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (SELECT id, w, least(len(w), 10) AS m FROM told WHERE side = 'i' AND len(w) > 0),
wins AS (SELECT DISTINCT id AS item, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM items)),
distinct_wins AS (SELECT DISTINCT m, win FROM wins),
doc_wins AS (SELECT id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win FROM (
  SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM told, (SELECT DISTINCT m FROM wins) WHERE side = 'd' AND len(w) >= m)),
found AS (SELECT id, m, s, win FROM doc_wins JOIN distinct_wins USING (m, win)),
hit AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(s, s + m)) AS p FROM found) GROUP BY id),
named AS (SELECT DISTINCT f.id, CAST(item AS VARCHAR) AS item FROM (SELECT DISTINCT id, m, win FROM found) f JOIN wins USING (m, win)),
listed AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM named GROUP BY id)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM told LEFT JOIN hit USING (id) LEFT JOIN listed USING (id) WHERE side = 'd'
""",
    "op2_line_dedup": r"""
WITH split AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
lines AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM split),
common AS (
  SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (top IS NULL OR doc_id = top), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (key) GROUP BY doc_id
""",
    "op3_mixing": r"""
WITH rows AS (
  SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4, 0) AS VARCHAR) AS d, coalesce(lang, '') AS l, coalesce(source, '') AS s, lang, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS HUGEINT) AS t FROM documents),
three AS (SELECT d, l, s, sum(t) AS tokens, sum(t) * 4 AS cap, CAST(1 AS HUGEINT) AS w FROM rows GROUP BY ALL),
two AS (SELECT d, l, sum(cap) AS cap, CAST(CASE l WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS HUGEINT) AS w FROM three GROUP BY ALL),
one AS (SELECT d, sum(cap) AS cap, CAST(CASE d WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS HUGEINT) AS w FROM two GROUP BY ALL),
root AS (SELECT least((SELECT sum(tokens) * 3 // 5 FROM three), (SELECT sum(cap) FROM one)) AS b),
one_f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * w + cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b * w AS f
  FROM one, root WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), d)),
one_b AS (SELECT d, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (), 0)) * w // sum(w) FILTER (NOT f) OVER () END AS b FROM one_f),
two_f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * w + cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b * w AS f
  FROM two JOIN one_b USING (d) WINDOW o AS (PARTITION BY d ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), l)),
two_b AS (SELECT d, l, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY d), 0)) * w // sum(w) FILTER (NOT f) OVER (PARTITION BY d) END AS b FROM two_f),
three_f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * w + cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= b * w AS f
  FROM three JOIN two_b USING (d, l) WINDOW o AS (PARTITION BY d, l ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), s)),
three_b AS (SELECT d, l, s, tokens, CASE WHEN f THEN cap ELSE (b - coalesce(sum(cap) FILTER (f) OVER (PARTITION BY d, l), 0)) * w // sum(w) FILTER (NOT f) OVER (PARTITION BY d, l) END AS b FROM three_f),
leaf AS (SELECT d, l, s, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS e, b - CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END * tokens AS rest FROM three_b),
ranked AS (SELECT rows.*, e, rest, sum(t) OVER (PARTITION BY d, l, s ORDER BY md5('17:' || CAST(e AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS upto FROM rows JOIN leaf USING (d, l, s)),
times AS (SELECT *, CAST(e + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM ranked)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place, domain, lang, source FROM (SELECT doc_id, unnest(range(n)) AS epoch, d AS domain, lang, source FROM times)
""",
    "op8_chat_pairs": r"""
WITH said AS (
  SELECT conv_id // 2 AS pair, conv_id % 2 AS side, turn, replace(coalesce(role, ''), '<|im_', '<| im_') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY turn, role, text) AS pos FROM said WHERE pair IN (SELECT pair FROM said GROUP BY pair HAVING count(DISTINCT side) = 2)),
compared AS (SELECT *, count(*) OVER p = 2 AND min(role) OVER p = max(role) OVER p AND min(text) OVER p = max(text) OVER p AS same FROM placed WINDOW p AS (PARTITION BY pair, pos)),
split AS (SELECT *, coalesce(min(pos) FILTER (NOT same) OVER (PARTITION BY pair), 2147483647) AS cut FROM compared),
parts AS (SELECT pair, CASE WHEN pos < cut THEN 0 ELSE side + 1 END AS part, pos, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line, length(text) + length('<|im_end|>') AS n FROM split WHERE pos >= cut OR side = 0)
SELECT pair AS pair_id, count(*) FILTER (part = 0) AS n_prompt, count(*) FILTER (part = 1) AS n_chosen, count(*) FILTER (part = 2) AS n_rejected,
  sha256(coalesce(string_agg(line, '' ORDER BY pos) FILTER (part = 0), '')) AS prompt_sha256, sha256(coalesce(string_agg(line, '' ORDER BY pos) FILTER (part = 1), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(line, '' ORDER BY pos) FILTER (part = 2), '')) AS rejected_sha256,
  CAST(coalesce(sum(n) FILTER (part = 1 AND role = 'assistant'), 0) AS BIGINT) AS chosen_counted, CAST(coalesce(sum(n) FILTER (part = 2 AND role = 'assistant'), 0) AS BIGINT) AS rejected_counted
FROM parts GROUP BY pair
""",
}
