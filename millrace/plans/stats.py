"""Statistics over open jobs. What the boards need of the jobs is counted once, into tallies; tallies of several inputs add up, so they may be kept and moved by what a run has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import enrich
from ..functions import vocabulary as v
from ..functions.text import percent, rounded
from ..operators.relational import keep_first, medians, share_of_max, spreads, top, value_counts, zero_filled
from ..operators.tables import settled


def _pay(rates: dict[str, float] | None) -> Column:
    live = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)) if rates else None
    return enrich.midpoint_usd(*(F.col(c) for c in ("salary_min", "salary_max", "salary_currency", "salary_period")), live)


def paid(jobs: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """Jobs with a plausible pay midpoint in US dollars a year, as ``pay``."""
    return jobs.withColumn("pay", _pay(rates)).where("pay IS NOT NULL")


def exact_median(df: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row with the exact median of a column; 0 for no rows."""
    return df.sparkSession.range(1).select().join(F.broadcast(medians(df, [], value, name)), how="left").select(F.coalesce(name, F.lit(0.0)).alias(name))


def median_by(df: DataFrame, key: str, value: str, least: int, k: int | None = None) -> DataFrame:
    """Exact median and count by key, for keys with at least ``least`` values, highest first; ties by key."""
    return _best(spreads(value_counts(df.where(F.col(key).isNotNull()), [key], value, "_n"), [key], value, "_n"), key, least, k)


def _best(spread_: DataFrame, key: str, least: int, k: int | None) -> DataFrame:
    got = spread_.where(F.col("n") >= least).select(key, F.col("median").alias("value"), "n")
    return got if k is None else top(got, k, F.desc("value"), F.asc(key))


def tallies(jobs: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """(board, key, value, n): how many open jobs say what, in one scan and one aggregate that combines before the shuffle. ``value`` is null where a board only counts; null keys are
    skipped, and so are boards of pay for jobs without any. ``posted`` counts times in microseconds."""
    none, pay, text = F.lit(None).cast("double"), F.col("_pay"), lambda c: F.col(c).cast("string")

    def said(board: str, key: Column, value: Column = none) -> Column:
        return F.struct(F.lit(board).alias("board"), key.alias("key"), value.alias("value"))

    def of_skills(board: str, value: Column = none) -> Column:
        return F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: said(board, s, value))

    one = [said("jobs", F.lit(""))] + [said(b, text(c)) for b, c in (("company", "company_slug"), ("remote", "remote_type"), ("seniority", "seniority"), ("country", "country"))]
    posted = said("posted", F.lit(""), F.unix_micros(F.col("posted_at").cast("timestamp")).cast("double"))
    of_pay = F.filter(F.concat(F.array(said("pay", F.lit(""), pay), said("company_pay", text("company_slug"), pay)), of_skills("skill_pay", pay)), lambda e: e["value"].isNotNull())
    every = F.concat(F.array(*one), F.filter(F.array(posted), lambda e: e["value"].isNotNull()), of_skills("skill"), of_pay)
    return jobs.withColumn("_pay", _pay(rates)).select(F.explode(every).alias("e")).select("e.*").where("key IS NOT NULL").groupBy("board", "key", "value").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame) -> DataFrame:
    """Tallies added up; what has come to 0 is left out."""
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every.groupBy("board", "key", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id): jobs of two states that came, changed, closed or opened again in between; only ids, digests and flags are compared."""
    narrow = lambda df, end: df.select(F.col("id").alias(f"id{end}"), F.struct("content_hash", F.coalesce("is_closed", F.lit(False)), "classification").alias(f"as{end}"))
    both = narrow(before, "0").join(narrow(after, "1"), F.col("id0") == F.col("id1"), "full")
    return both.where(~F.col("as0").eqNullSafe(F.col("as1"))).select(F.coalesce("id1", "id0").alias("id"))


def moved(state: DataFrame, was: DataFrame, now: DataFrame, ids: DataFrame | None = None, rates: dict[str, float] | None = None) -> DataFrame:
    """The tallies after a run: ``state`` less what the jobs ``ids`` said when they were open before (``was``), more what they say now. Other jobs aren't counted again; without ``ids``
    ``was`` and ``now`` hold the touched jobs alone. Pay is told by ``rates``, so other rates need new tallies."""
    if ids is not None:
        was, now = was.join(ids, "id", "left_semi"), now.join(ids, "id", "left_semi")
    return merged(state, tallies(was, rates).withColumn("n", -F.col("n")), tallies(now, rates))


def company_names(df: DataFrame) -> DataFrame:
    return keep_first(df.select("company_slug", "company_name", "ord"), ["company_slug"], [F.col("ord")]).select("company_slug", "company_name")


def _headline(state: DataFrame, pay: DataFrame, generated_at: Column) -> DataFrame:
    of = lambda board, more=F.lit(True): F.coalesce(F.sum(F.when((F.col("board") == board) & more, F.col("n"))), F.lit(0).cast("long"))
    kind = lambda t: of("remote", F.col("key") == t)
    since = (F.unix_micros(generated_at.cast("timestamp")) - F.lit(7 * 86_400_000_000)).cast("double")
    got = state.agg(
        of("jobs").alias("roles"), F.count_if(F.col("board") == "company").alias("companies"), kind("remote").alias("remote"), kind("hybrid").alias("hybrid"), kind("onsite").alias("onsite"),
        percent(kind("remote"), of("jobs")).alias("remote_percent"), of("posted", F.col("value") >= since).alias("posted_this_week"),
    )
    return got.join(F.broadcast(pay.where("board = 'pay'").select(F.col("median").alias("median_pay"))), how="left").withColumn("median_pay", F.coalesce("median_pay", F.lit(0.0)))


def headline(jobs: DataFrame, generated_at: Column, rates: dict[str, float] | None = None) -> DataFrame:
    return boards(settled(tallies(jobs, rates), "tallies"), company_names(jobs), generated_at)["headline"]


def boards(state: DataFrame, names: DataFrame, generated_at: Column) -> dict[str, DataFrame]:
    """Every table of the statistics page from tallies (written ones: each table reads them) and company names; leaderboards carry ``share``, their value over the largest.
    The spreads of all boards of pay are found together."""
    spark = state.sparkSession
    pay = spreads(state.where("board IN ('pay', 'company_pay', 'skill_pay')"), ["board", "key"], "value")
    counted = lambda board, key: state.where(F.col("board") == board).select(F.col("key").alias(key), "n")
    best = lambda board, key, least, k: _best(pay.where(F.col("board") == board).withColumnRenamed("key", key), key, least, k)
    order = spark.createDataFrame([(s, k, v.SENIORITY_LABELS[s]) for k, s in enumerate(v.SENIORITY_ORDER)], "seniority string, place int, label string")
    return {
        "headline": _headline(state, pay, generated_at),
        "top_paying": share_of_max(best("company_pay", "company_slug", 3, 5), "value").join(names, "company_slug"),
        "top_hiring": share_of_max(top(counted("company", "company_slug"), 5, F.desc("n"), F.asc("company_slug")), "n").join(names, "company_slug"),
        "top_skills": share_of_max(top(counted("skill", "skill"), 12, F.desc("n"), F.asc("skill")), "n"),
        "top_paid_skills": share_of_max(best("skill_pay", "skill", 5, 6), "value"),
        "seniority": share_of_max(zero_filled(order, counted("seniority", "seniority"), "seniority").where("n > 0"), "n").orderBy("place"),
        "countries": share_of_max(top(counted("country", "country"), 6, F.desc("n"), F.asc("country")), "n"),
    }


def stats(jobs: DataFrame, generated_at: Column, rates: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """``boards`` of the jobs: they are tallied in one scan; names are read beside."""
    return boards(settled(tallies(jobs, rates), "tallies"), company_names(jobs), generated_at)


def leaders(board: DataFrame, *order: Column) -> DataFrame:
    """A leaderboard, of a page's length, with ``rank`` from 1."""
    return board.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def spread(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, low, median, high) of a column, nulls skipped."""
    return spreads(value_counts(df, [key], value, "_n"), [key], value, "_n")


def salary_pages(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """For each page id the count, least, median and largest midpoint of its USD yearly jobs; pages without any stay, with count 0.

    The ends of the published distribution are the least and largest value."""
    some = F.coalesce("salary_min", F.lit(0)) != 0
    ok = jobs.where(some & F.coalesce("salary_currency", F.lit("")).isin("", "USD") & F.coalesce("salary_period", F.lit("")).isin("", "year"))
    mid = F.when(F.coalesce("salary_max", F.lit(0)) != 0, (F.col("salary_min") + F.col("salary_max")) / 2).otherwise(F.col("salary_min"))
    return zero_filled(pages, spread(ok.select(F.explode("clusters").alias("id"), mid.alias("mid")), "id", "mid"), "id")


def salary_json(stats_: DataFrame, noun: str = "label") -> DataFrame:
    """The structured-data object of each salary page; null without jobs."""
    about = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Occupation").alias("@type"), F.concat(F.regexp_replace(noun, " /.*", ""), F.lit(" (AI engineering)")).alias("name"),
        F.struct(F.lit("MonetaryAmountDistribution").alias("@type"), F.lit("USD").alias("currency"), F.lit("P1Y").alias("duration"), rounded(F.col("median")).alias("median"),
                 rounded(F.col("low")).alias("percentile10"), rounded(F.col("high")).alias("percentile90")).alias("estimatedSalary"),
    )
    return stats_.withColumn("json", F.when(F.col("n") > 0, F.to_json(about)))
