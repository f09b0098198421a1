"""Relational building blocks with stated order and ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import settled


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: partial aggregation before the shuffle, no sort of a whole group."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(df.columns)


def keep_last_in_first_place(df: DataFrame, keys: list[str], order: Column, place: str = "place") -> DataFrame:
    """The last row of each key, with the position of its first (as overwriting in an insertion-ordered map does)."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(order).alias(place))
    return got.select(*keys, "_r.*", place).select(*df.columns, place)


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: a take-ordered, not a full sort."""
    return df.orderBy(*order).limit(k)


def ranked(df: DataFrame, k: int, *order: Column, name: str = "rank", start: int = 0) -> DataFrame:
    """The first k rows with their rank; only those k are numbered."""
    return top(df, k, *order).withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1 + start).cast("long"))


def counts(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """Rows for each value, nulls skipped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def facets(df: DataFrame, plain: list[str], exploded: list[str]) -> DataFrame:
    """(facet, value, n): counts of scalar columns and of array elements, values as strings. One scan and one aggregate: each row
    gives one entry for every value it has, so facets don't multiply; nulls are skipped."""

    def entries(c: str, values: Column) -> Column:
        return F.transform(F.coalesce(values.cast("array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("facet"), x.alias("value")))

    own = [entries(c, F.array(c)) for c in plain] + [entries(c, F.col(c)) for c in exploded]
    return df.select(F.explode(F.concat(*own)).alias("e")).select("e.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, keys: list[str], value: str, name: str = "n") -> DataFrame:
    """(keys, value as double, name): how often each value occurs, nulls skipped. Counts of several inputs add up, so they may be kept and merged."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias(value)).agg(F.count("*").alias(name))


def spreads(counted: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """(keys, n, low, median, high): exact, from rows that say how often (``n``) a value occurs; each value once a key. No keys give one row or none; null keys are a group.

    The rows are dealt to ranges of keys and values of about equal numbers, whose borders Spark samples from them, and are written so, which reads the input once. Running counts of
    the ranges tell which of them hold a key's middle, and only these are ordered. So a task never orders more than a range, however values crowd or stray."""
    ks = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
    named = [F.col(k).alias(a) for k, a in zip(keys, ks, strict=True)] if keys else [F.lit(0).alias("_k0")]
    own = counted.select(*named, F.col(value).cast("double").alias("_v"), F.col(n).cast("long").alias("_c"))
    dealt = settled(own.repartitionByRange(*ks, "_v").withColumn("_range", F.spark_partition_id()), "ranges")
    whole, lower, upper = W.partitionBy(*ks), F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)

    def middle(rows: DataFrame, by: list[str], order: str, before: Column) -> DataFrame:
        """The rows that hold the lower or the upper middle, by running counts."""
        rows = rows.withColumn("_upto", before + F.sum("_c").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
        held = lambda at: (F.col("_upto") >= at) & (F.col("_upto") - F.col("_c") < at)
        return rows.withColumns({"_lo": held(lower), "_hi": held(upper)}).where("_lo OR _hi")

    sums = dealt.groupBy(*ks, "_range").agg(F.sum("_c").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    sums = sums.withColumns({"_all": F.sum("_c").over(whole), "_low": F.min("_low").over(whole), "_high": F.max("_high").over(whole)})
    found = middle(sums, ks, "_range", F.lit(0)).withColumn("_before", F.col("_upto") - F.col("_c")).drop("_c", "_upto", "_lo", "_hi")
    found = found.withColumnsRenamed({c: f"{c}_" for c in [*ks, "_range"]})
    near = dealt.join(found, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ks] + [F.col("_range") == F.col("_range_")])
    ends = middle(near, [*ks, "_range"], "_v", F.col("_before")).groupBy(*ks).agg(
        F.max(F.when(F.col("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_hi"), F.col("_v"))).alias("_b"), F.max("_all").alias("_all"), F.max("_low").alias("_low"), F.max("_high").alias("_high"),
    )
    back = [F.col(a).alias(k) for k, a in zip(keys, ks, strict=False)]
    return ends.select(*back, F.col("_all").alias("n"), F.col("_low").alias("low"), ((F.col("_a") + F.col("_b")) / 2).alias("median"), F.col("_high").alias("high"))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): the exact median of ``value`` (double) for each key; keys without values are absent, no keys give one row or none. See ``spreads``."""
    return spreads(value_counts(df, keys, value, "_n"), keys, value, "_n").select(*keys, F.col("median").alias(name))


def share_of_max(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """value over the largest value, which counts as at least 1; the maximum is one aggregate row, joined."""
    most = df.agg(F.greatest(F.lit(1), F.max(value)).alias("_most"))
    return df.crossJoin(F.broadcast(most)).withColumn(name, F.col(value) / F.col("_most")).drop("_most")


def with_default_lists(df: DataFrame, lists: DataFrame, on: str, *cols: str) -> DataFrame:
    """Left join of gathered arrays; rows without any get empty ones."""
    out = df.join(lists, on, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in cols})


def zero_filled(domain: DataFrame, found: DataFrame, on: str, name: str = "n") -> DataFrame:
    """Counts for every value of a fixed domain, 0 where nothing was found."""
    return domain.join(found, on, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """A small dimension joined left, with a default; Spark broadcasts it if it is small enough."""
    return df.join(dim, on, "left").withColumn(value, F.coalesce(value, default))


def containing(pages: DataFrame, items: DataFrame, page_key: str, array_col: str) -> DataFrame:
    """Every page with the items whose array holds its key; pages without items stay. An equi-join on exploded keys, no cross join."""
    return pages.join(items.withColumn(page_key, F.explode(F.array_distinct(array_col))), page_key, "left")


def other_pairs(df: DataFrame, key: str) -> DataFrame:
    """Each row of a small table with every other row (navigation links); for tables of fixed, small size only."""
    return df.alias("a").crossJoin(df.select(F.col(key).alias("other"))).where(F.col("other") != F.col(key))


def islands(df: DataFrame, keys: list[str], order: Column, breaks: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which ``breaks`` holds begins a new one."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(breaks.cast("int")).over(w))


def cross_source_duplicates(jobs: DataFrame, key: str = "dedup_key", order: list[Column] | None = None) -> DataFrame:
    """Extension: of jobs with one dedup key, the earliest ingested."""
    return keep_first(jobs, [key], order or [F.col("ingested_at"), F.col("id")])
