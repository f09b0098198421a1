"""State tables as pure functions (old, batch) -> new, to be written as a new version; upserts without MERGE.

Every function is one full-outer or left join on the key, so its cost follows state plus batch and its result can be
recomputed from both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a job that its first insert fixes for good.
FIXED = ["company_id", "source_id", "external_id", "slug", "is_direct", "posted_at", "ingested_at", "is_new", "is_featured", "expires_at"]


def upsert(old: DataFrame, batch: DataFrame, key: str, mutable: list[str], on_conflict: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``batch`` replace the ``mutable`` columns of old rows with their key, or are inserted whole; other columns and rows stay.

    ``on_conflict``: values set where a row is replaced. ``batch`` has one row a key."""
    on_conflict = on_conflict or {}
    o, b = old.select(F.struct("*").alias("o"), F.col(key).alias("_k")), batch.select(F.struct("*").alias("b"), F.col(key).alias("_k"))
    names = batch.columns
    both = o.join(b, "_k", "full_outer")

    def value(c: str) -> Column:
        was, new = F.col(f"o.`{c}`"), F.col(f"b.`{c}`") if c in names else F.lit(None)
        kept, gone = F.col("o").isNotNull(), F.col("b").isNull()
        replaced = on_conflict[c] if c in on_conflict else new if c in mutable else was
        return F.when(gone, was).when(kept, replaced).otherwise(new).alias(c)

    return both.select(*(value(c) for c in old.columns))


def upsert_companies(old: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(old, batch, "id", ["name", "domain", "ats_provider", "ats_token", "stage"])


def upsert_sources(old: DataFrame, batch: DataFrame) -> DataFrame:
    return upsert(old, batch, "id", ["endpoint_url"], {"status": F.lit("active")})


def upsert_jobs(old: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` rows are inserted new and open, or update everything but FIXED and reopen."""
    fresh = batch.withColumns({"is_new": F.lit(True), "is_closed": F.lit(False)})
    fresh = fresh.withColumn("is_featured", F.coalesce("is_featured", F.lit(False)) if "is_featured" in fresh.columns else F.lit(False))
    return upsert(old, fresh, "id", [c for c in old.columns if c not in [*FIXED, "id"] and c in fresh.columns], {"is_closed": F.lit(False)})


def replace_bridge(old: DataFrame, processed: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Bridge rows of processed keys are replaced by the batch's, each pair once; a key without new rows loses all."""
    return old.join(processed.select(key).distinct(), key, "left_anti").unionByName(batch.distinct())


def insert_absent(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return old.unionByName(batch.dropDuplicates([key]).join(old, key, "left_anti"), allowMissingColumns=True)


def change_gate(batch: DataFrame, old: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """``batch`` with changed: false only where an open row with the same digest exists."""
    seen = old.select(key, F.col(digest).alias("_was"), F.col("is_closed").alias("_closed"))
    same = F.coalesce((F.col("_was") == F.col(digest)) & ~F.col("_closed"), F.lit(False))
    return batch.join(seen, key, "left").withColumn("changed", ~same).drop("_was", "_closed")


def mark_seen(old: DataFrame, seen: DataFrame, at: Column, key: str = "id") -> DataFrame:
    hit = old.join(seen.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.withColumns({"last_seen_at": F.when(F.col("_hit"), at).otherwise(F.col("last_seen_at")), "is_closed": F.when(F.col("_hit"), F.lit(False)).otherwise(F.col("is_closed"))}).select(old.columns)


def close_stale(old: DataFrame, polled: DataFrame, run_start: Column, source: str = "source_id") -> DataFrame:
    """Open jobs of polled sources that this run didn't see are closed; direct ones never are. ``polled``: source ids of feeds that answered."""
    hit = old.join(polled.select(F.col(polled.columns[0]).alias(source)).distinct().withColumn("_polled", F.lit(True)), source, "left")
    stale = F.col("_polled").isNotNull() & ~F.col("is_direct") & ~F.col("is_closed") & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < run_start))
    return hit.withColumn("is_closed", F.col("is_closed") | F.coalesce(stale, F.lit(False))).select(old.columns)


def poll_targets(companies: DataFrame, sources: DataFrame) -> DataFrame:
    """Active sources with their companies; the token falls back to the slug."""
    c = companies.select(F.col("id").alias("company_id"), "name", "slug", "domain", F.col("ats_provider"), F.coalesce("ats_token", "slug").alias("ats_token"))
    return c.join(sources.where("status = 'active'").select("company_id", F.col("id").alias("source_id")), "company_id")
