"""From ``documents`` to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on every row it is given, and returns the columns of ``documents`` (the last one
returns ids). ``run`` writes each stage's result to the shared folder and reads it back for the next.

Defined cases, for every stage: an empty table gives an empty one; columns beyond those of ``documents`` pass through the first four stages, also where
they are named like an operator's outputs, and are left out by the last; texts of any length are taken whole. What a stage does with nulls, empty texts, ties and
repeated rows is said there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, line_dedup, minhash, mixing, quality_rules
from millrace.llm.queries import WEIGHTS, domain, table, tokenizer_path
from millrace.llm.shared import written


def aside(docs: DataFrame, *outputs: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are named like an operator's outputs renamed, and the expressions that give all columns back."""
    names = {c: f"_document_{c}" if c.lower() in outputs else c for c in docs.columns}
    return docs.withColumnsRenamed(names), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor a learned rule rejects.

    Null and empty texts have no words, so the base rule rejects them; equal rows are judged alike, each on its own."""
    rules = quality_rules.learn(quality_rules.labelled(docs, table(spark, sf_dir, "labels")))
    docs, back = aside(docs, *quality_rules.STATS, "base_failed", "rule", "kept")
    return quality_rules.judge(docs, rules).where("kept").select(back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that many documents share; n_chars follows the text.

    A null text becomes an empty one (one empty line, which is never dropped). Rows of one id are one document in the count of documents that share a line."""
    docs, back = aside(docs, "n_lines", "n_dropped", "kept_text")
    found = line_dedup.dedup_lines(docs).withColumn("text", F.col("kept_text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long")).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id.

    Texts without words are linked with nothing and stay. Rows of one id are one document: those with words all stay or none; null ids count as one id, the smallest."""
    docs, back = aside(docs, "n_shingles", "component_id", "kept")
    return minhash.near_duplicates(docs).where("kept").select(back)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source up to its share of as many tokens as there are, up to four times each.

    Texts without words cost nothing and come where their place in the order does; null sources or languages are the empty name; rows of one id are taken or left together."""
    docs, back = aside(docs, "epoch", "domain")
    return mixing.mix_sources(docs, domain(), WEIGHTS).select(back)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of what they decode to.

    Null and empty texts have no ids; every row is encoded alone."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path(), decoded=True)
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("mixing", mixture), ("encoding", tokens)]
#: SQL for the rows of ``run``: none, as learned rules and encoding have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
