"""The write path as one plan: postings and state in, next state out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import enrich
from ..functions import vocabulary as v
from ..functions.text import content_hash, dedup_key, job_id, job_slug, normalized_title, number_text, present, slugify, strip_html
from ..operators import state
from ..operators.tables import Versions, settled
from ..sources.schemas import JOB_SKILLS, JOBS, SKILLS, flat
from ..sources.scorer import MEMO, Remembered

#: A second scorer: (job id, title, description, location) rows in, id and a JSON object (enrich.scorer_record) out.
Scorer = Callable[[DataFrame], DataFrame]
SCORED_CHARS = 6000


def prepared(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """Every posting once, with its poll target, id, digest and text; ``valid`` is false without a target, url or title."""
    t = targets.select("ats_token", "ats_provider", "company_id", "source_id", "slug").withColumn("_known", F.lit(True))
    df = postings.withColumnRenamed("slug", "ats_token").join(t, ["ats_token", "ats_provider"], "left")
    valid = F.col("_known").isNotNull() & (F.coalesce("apply_url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    text = F.coalesce("description_text", F.when(present(F.col("description_html")).isNotNull(), strip_html(F.col("description_html"))))
    digest = content_hash(F.col("title"), F.coalesce("description_text", "description_html"), F.col("location_raw"), number_text(F.col("salary_min")), number_text(F.col("salary_max")))
    ok = F.col("valid")
    return df.withColumn("valid", valid).drop("_known").withColumns({"id": F.when(ok, job_id(F.col("slug"), F.col("external_id"))), "content_hash": F.when(ok, digest), "_text": F.when(ok, text)})


def classified(df: DataFrame, scorer: Scorer | None = None) -> DataFrame:
    """Adds cls (classification, confidence, via) and x (the scorer's record). Titles ruled out never reach the scorer: they are split off
    before it, as Spark promises no order between a filter and a UDF."""
    df = df.withColumn("_h", enrich.classify_title(F.col("title")))
    if scorer is None:
        return df.withColumns({"cls": enrich.cascade(F.col("_h")), "x": enrich.scorer_record(F.lit(None).cast("string"))})
    ask = df.where(F.coalesce(F.col("_h.classification") != "out", F.lit(True))).select("id", "title", F.substring(F.coalesce("_text", F.lit("")), 1, SCORED_CHARS).alias("text"), "location_raw")
    got = scorer(ask).select("id", enrich.scorer_record(F.col("record")).alias("x"))
    return df.join(got, "id", "left").withColumn("cls", enrich.cascade(F.col("_h"), F.col("x.in_scope"), F.col("x.confidence")))


def jobs_of(df: DataFrame, run_start: Column, *carried: str) -> DataFrame:
    """Job rows: each field from the posting, else from its text, else from the scorer; columns ``carried`` stay."""
    loc = enrich.parse_location(F.col("location_raw"), F.col("remote_type"), F.col("remote_hint"))
    df = df.withColumn("_loc", loc)
    pick = lambda *c: F.coalesce(*c)
    skills = F.when(F.col("cls.classification") == "in", enrich.tag_skills(F.coalesce("_text", F.lit("")), F.col("x.skills"))).otherwise(F.array().cast("array<string>"))
    return df.select(
        "id", "company_id", "source_id", "external_id", job_slug(F.col("slug"), F.col("title"), F.col("external_id")).alias("slug"), "title", normalized_title(F.col("title")).alias("normalized_title"),
        "description_html", F.col("_text").alias("description_text"), "apply_url", "location_raw", pick("_loc.country", "x.country").alias("country"), F.lit(None).cast("string").alias("region"),
        pick("_loc.city", "x.city").alias("city"), pick("_loc.remote_type", "x.remote_type").alias("remote_type"), pick(enrich.seniority(F.col("title")), F.col("x.seniority")).alias("seniority"),
        *(pick(c, f"x.{c}").alias(c) for c in ("salary_min", "salary_max", "salary_currency", "salary_period")),
        F.col("cls.classification").alias("classification"), F.col("cls.confidence").alias("classification_confidence"), F.lit(False).alias("is_direct"), "posted_at", "updated_at",
        run_start.alias("ingested_at"), "content_hash", dedup_key(F.col("slug"), F.col("title"), F.col("location_raw")).alias("dedup_key"), run_start.alias("last_seen_at"), skills.alias("skills"), *carried,
    )


def skill_id(name: Column) -> Column:
    return F.concat(F.lit("sk_"), slugify(name))


def skills(spark: SparkSession) -> DataFrame:
    """The taxonomy (id, name, cluster); a table of the vocabulary's size."""
    rows = [(name, cluster) for cluster, _, names in v.CLUSTERS for name in names]
    return spark.createDataFrame(rows, "name string, cluster string").select(skill_id(F.col("name")).alias("id"), "name", "cluster")


def gated(postings: DataFrame, jobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Every posting once: id, ``changed`` (null for one that is left out), ``stays`` for the last changed one of an id, and in ``p`` what a changed one says.

    Postings of one id count in their order (``ord`` where the feed gives one, else by their dates and content): one that says the same as the one before it is unchanged."""
    ready = prepared(postings, targets)
    place = ["ord"] if "ord" in ready.columns else ["updated_at", "posted_at", "content_hash", "apply_url", "title"]
    # what is left out has no id; it is dealt by its content, so that it makes no large group
    dealt = F.coalesce("id", F.concat(F.lit("-"), F.xxhash64("ats_token", "external_id", "title", "apply_url", "description_text", "description_html").cast("string")))
    told = state.change_gate(ready, jobs).withColumn("_by", dealt)
    before = F.lag("content_hash").over(W.partitionBy("_by").orderBy(*(F.asc_nulls_first(c) for c in place)))
    told = told.withColumn("changed", F.when(F.col("valid"), F.when(before.isNull(), F.col("changed")).otherwise(before != F.col("content_hash"))))
    last = F.row_number().over(W.partitionBy("_by", "changed").orderBy(*(F.desc_nulls_last(c) for c in place))) == 1
    names = [c for c in ready.columns if c not in ("valid", "ord", "ats_token", "ats_provider")]
    return told.select("id", "changed", (F.col("changed") & last).alias("stays"), F.when(F.col("changed"), F.struct(*names)).alias("p"))


def run(jobs: DataFrame, bridge: DataFrame, postings: DataFrame, targets: DataFrame, polled: DataFrame, run_start: Column, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, job_skills, counters) after one run. ``polled``: source ids whose feeds answered.

    The run's log (one row a posting), the rows it makes and the jobs after it are written in turn, so each input is read once, a posting is classified and tagged once and a scorer
    is asked once; links and counters are derived from these tables. ``fetched`` counts postings as they came, before any is left out."""
    log = settled(gated(postings, jobs, targets), "run-log")
    new = settled(jobs_of(classified(log.where("changed").select("stays", "p.*"), scorer), run_start, "stays"), "run-jobs")
    kept = new.where("stays").drop("stays")
    after = state.mark_seen(state.upsert_jobs(jobs, kept.drop("skills")), log.where("NOT changed"), run_start)
    after = settled(state.close_stale(after.withColumn("_was_closed", F.col("is_closed")), polled, run_start), "jobs-after")
    links = state.replace_bridge(bridge, kept.select(F.col("id").alias("job_id")), kept.select(F.col("id").alias("job_id"), F.explode("skills").alias("s")).select("job_id", skill_id(F.col("s")).alias("skill_id")), "job_id")
    failed = targets.select("source_id").distinct().join(polled.select(F.col(polled.columns[0]).alias("source_id")), "source_id", "left_anti").agg(F.count("*").alias("feeds_failed"))
    counters = log.agg(F.count("*").alias("fetched"), F.count_if("changed").alias("processed"), F.count_if(~F.col("changed")).alias("unchanged"))
    for one in (new.agg(F.count_if(F.col("classification") == "in").alias("in_scope")), after.agg(F.count_if(F.col("is_closed") & ~F.col("_was_closed")).alias("closed")), failed):  # one row each
        counters = counters.crossJoin(one)
    return after.drop("_was_closed"), links, counters


def commit(store: Versions, name: str, postings: DataFrame, targets: DataFrame, polled: DataFrame, run_start: Column, scorer: Scorer | None = None) -> int:
    """The version of the tables jobs, job_skills, skills and run_counters that the run ``name`` published: all of them, or none if it fails.

    A run that was committed before is not made again; the version it published is returned. Earlier versions stay readable. With a scorer, its answers are kept as the table
    scorer_memo, and it is asked only for texts that have none there."""
    done = store.of_run(name)
    if done is not None:
        return done
    base = store.latest()
    memory = Remembered(scorer, store.read("scorer_memo", flat(MEMO), base)) if scorer else None
    jobs, links, counters = run(store.read("jobs", JOBS, base), store.read("job_skills", JOB_SKILLS, base), postings, targets, polled, run_start, memory)
    links = settled(links, "links")
    named = links.select(F.col("skill_id").alias("id")).distinct().join(skills(store.spark), "id")
    known = state.insert_absent(store.read("skills", SKILLS, base), named, "id")
    asked = {"scorer_memo": memory.after} if memory else {}
    return store.commit(name, {"jobs": jobs, "job_skills": links, "skills": known, "run_counters": counters, **asked}, base)
