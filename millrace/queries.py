"""Queries over the provided tables, one or more for each operator, each with the same query as SQL.

The tables hold no postings, so an operator is applied to a column of like shape; its vocabulary is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import enrich, text, vocabulary
from .operators import relational as rel
from .operators import state
from .plans import pages, stats
from .sources import feeds, jsonld

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- flagship: highest-paying groups

@query("""
SELECT p_brand AS brand, median(l_extendedprice) AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_brand HAVING count(*) >= 3 ORDER BY value DESC, brand LIMIT 5
""")
def top_paying_groups(spark, sf):
    t = Tables(spark, sf)
    df = t.lineitem.select("l_partkey", "l_extendedprice").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    return stats.median_by(df, "brand", "l_extendedprice", 3, 5)


# ---- text scalars

@query(r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<\s*br\s*/?>', chr(10), 'gi'), '<\s*li[^>]*>', chr(10) || '• ', 'gi'),
  '</\s*(p|div|ul|ol|h[1-6]|tr|section|article)\s*>', chr(10) || chr(10), 'gi'), '<[^>]+>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM b)
SELECT page_id, regexp_replace(t, '^\s+|\s+$', '', 'g') AS body FROM c
""")
def strip_html(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.strip_html(F.col("html")).alias("body"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS decoded FROM pages
""")
def decode_entities(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.decode_entities(F.col("html")).alias("decoded"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || '  (' || p_brand || ')'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slugify(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", text.slugify(F.concat("p_name", F.lit("  ("), "p_brand", F.lit(")"))).alias("slug"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM pages")
def normalized_key(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.normalized_title(F.col("url")).alias("normalized"))


@query("""
SELECT o_orderkey, 'j_' || substr(sha1(o_custkey || '|' || o_orderkey), 1, 16) AS id, 'c_' || regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS company,
  substr(regexp_replace(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || regexp_replace(regexp_replace(lower(o_orderstatus), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 6), 1, 110) AS slug
FROM orders
""")
def stable_id(spark, sf):
    s = lambda c: F.col(c).cast("string")
    return Tables(spark, sf).orders.select(
        "o_orderkey", text.job_id(s("o_custkey"), s("o_orderkey")).alias("id"), text.company_id(F.col("o_orderpriority")).alias("company"), text.job_slug(F.col("o_orderpriority"), F.col("o_orderstatus"), s("o_orderkey")).alias("slug")
    )


@query("SELECT doc_id, sha256(coalesce(text, '') || coalesce(lang, '') || coalesce(source, '') || coalesce(CAST(n_chars AS VARCHAR), '')) AS digest FROM documents")
def content_hash(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.content_hash(F.col("text"), F.col("lang"), F.col("source"), text.number_text(F.col("n_chars").cast("double"))).alias("digest"))


@query("SELECT s_suppkey, lower(s_name) || '|' || trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) || '|' || lower(r_name) AS dedup_key FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def dedup_key(spark, sf):
    t = Tables(spark, sf)
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select("s_suppkey", text.dedup_key(F.lower("s_name"), F.col("n_name"), F.col("r_name")).alias("dedup_key"))


WORDS = ["the", "der", "les", "una", "of", "idiot", "in", "no-such"]


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9]){w}([^a-z0-9]|$)') THEN '{w}' END" for w in WORDS) + "], lambda x: x IS NOT NULL), ',') AS tags FROM documents")
def vocab_tag(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", F.array_join(enrich.tag_terms(F.col("text"), WORDS), ",").alias("tags"))


@query("""
SELECT p_partkey, CASE WHEN regexp_matches(p_type, '(?i)\\bpromo') THEN 'promo' WHEN regexp_matches(p_type, '(?i)(steel|tin)\\b') THEN 'metal' WHEN regexp_matches(p_type, '(?i)^economy|^small') THEN 'cheap' ELSE 'Other' END AS kind FROM part
""".replace("\\\\", "\\"))
def ordered_case_classify(spark, sf):
    cases = [("promo", r"\bpromo"), ("metal", r"(steel|tin)\b"), ("cheap", "^economy|^small")]
    return Tables(spark, sf).part.select("p_partkey", enrich.first_match(F.col("p_type"), cases, otherwise="Other").alias("kind"))


@query("""
WITH h AS (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)idiot|scum') THEN 'out' WHEN regexp_matches(text, '(?i)^the') THEN 'in' END AS c FROM documents),
j AS (SELECT h.*, l.quality = 1 AS s, CASE WHEN l.toxic = 1 THEN 0.5 ELSE 0.8 END AS conf FROM h LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))
SELECT doc_id, CASE WHEN c = 'out' THEN 'out' WHEN c = 'in' THEN CASE WHEN NOT s AND conf >= 0.7 THEN 'out' ELSE 'in' END WHEN s IS NULL THEN 'out' WHEN s THEN 'in' ELSE 'out' END AS classification,
  CAST(CASE WHEN c = 'out' THEN 0.9 WHEN c = 'in' THEN CASE WHEN NOT s AND conf >= 0.7 THEN conf ELSE 0.85 END WHEN s IS NULL THEN 0.3 ELSE conf END AS DOUBLE) AS confidence,
  CASE WHEN c = 'out' THEN 'heuristic' WHEN c = 'in' THEN CASE WHEN NOT s AND conf >= 0.7 THEN 'llm' ELSE 'heuristic' END WHEN s IS NULL THEN 'default' ELSE 'llm' END AS via FROM j
""")
def cascade_with_veto(spark, sf):
    t = Tables(spark, sf)
    scored = t.labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("s"), F.when(F.max("toxic") == 1, 0.5).otherwise(0.8).alias("conf"))
    df = t.documents.select("doc_id", enrich.classify_title(F.col("text"), ["^the"], ["idiot|scum"]).alias("h")).join(scored, "doc_id", "left")
    return df.select("doc_id", enrich.cascade(F.col("h"), F.col("s"), F.col("conf")).alias("c")).select("doc_id", "c.*")


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '£' WHEN o_orderkey % 3 = 1 THEN '€' ELSE '$' END AS sign, CAST(floor(o_totalprice / 1000) AS BIGINT) AS lo, CAST(floor(o_totalprice / 500) AS BIGINT) AS hi FROM orders),
s AS (SELECT *, list_filter([lo * 1000.0, hi * 1000.0], lambda x: x >= 1000) AS nums FROM r)
SELECT o_orderkey, CAST(list_min(nums) AS DOUBLE) AS salary_min, CAST(CASE WHEN list_max(nums) <> list_min(nums) THEN list_max(nums) END AS DOUBLE) AS salary_max,
  CASE WHEN len(nums) > 0 THEN CASE sign WHEN '£' THEN 'GBP' WHEN '€' THEN 'EUR' ELSE 'USD' END END AS salary_currency, CASE WHEN len(nums) > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END END AS salary_period FROM s
""")
def extract_numbers(spark, sf):
    sign = F.when(F.col("o_orderkey") % 3 == 0, "£").when(F.col("o_orderkey") % 3 == 1, "€").otherwise("$")
    n = lambda d: F.floor(F.col("o_totalprice") / d).cast("string")
    shown = F.concat(sign, n(1000), F.lit("K - "), sign, n(500), F.lit("k"), F.when(F.col("o_orderkey") % 2 == 0, " per month").otherwise(""))
    return Tables(spark, sf).orders.select("o_orderkey", enrich.parse_salary(shown).alias("s")).select("o_orderkey", "s.*")


@query("SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN regexp_matches(split_part(url, '/', 3), '(?i)remote|hybrid|onsite|anywhere|global') THEN NULL ELSE regexp_replace(split_part(replace(url, '://', '|'), '|', 1), '^\\s+|\\s+$', '', 'g') END AS first_segment FROM pages")
def url_first_segment(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.substring_index(F.split_part("url", F.lit("://"), F.lit(2)), "/", 1).alias("host"), enrich.city(F.replace("url", F.lit("://"), F.lit("|"))).alias("first_segment"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    return Tables(spark, sf).events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


#: Words by which a table's own columns spell places, titles and skills; SQL evaluates the rules' patterns on the same text.
CITIES = ["London, Ontario", "Hamburg, DE", "Paris|Lyon", "Berlin", "MÜNCHEN", "U.S.", "usa", "Toronto", "Austin, TX", "Austin, tx", "Dublin", "Bengaluru", "Singapore", "Sydney", "Amsterdam", "Leeds, England", "Indiana", "IN", "Portland, OR", "", "Anywhere", "Global", "Lagos", "U.K.", " Mumbai "]
MODES = {"MACHINERY": " / Remote", "BUILDING": " (hybrid)", "AUTOMOBILE": ", United States", "HOUSEHOLD": " remotely"}
LEVELS = {"1-URGENT": "Senior ", "2-HIGH": "Staff ", "3-MEDIUM": "Sr. ", "4-NOT SPECIFIED": "Head of ", "5-LOW": "Associate "}
NOUNS = ["Data Scientist", "Engineering Manager", "Internal Tools Engineer", "Sales Engineer", "ML Engineer", "Research Scientist", "Backend Developer", "Agents", "Data Engineer", "Product Manager", "Prompt Engineer", "Site Reliability Engineer", "Intern", "Recruiter",
         "AI Architect", "Member of Technical Staff", "Cook", "Principal Designer", "Evaluation Lead", "Post-training Researcher", "Storage", "Forward Deployed Engineer", "Data Analyst", "Director, Strategy", "New Grad, NLP"]
FIELDS = {"MACHINERY": ", Inference", "BUILDING": " (LLM)", "AUTOMOBILE": ", Platform"}
STACKS = ["RAG with C++", "cloud storage category", "Fine-tuning: LoRA/PEFT", "azure ml", "PyTorch; CI/CD.", "go to market", "Azure", "gpus", "GPU", "tool use, MCP", "multi-agent", "LLM-as-judge", "no-python", "JavaScript", "Typescript", "OpenAI  API", "openai api", "vLLM/Ray", "array", "Rust.", "deep learning", "Vertex AI", "DPO+RLHF", "nlp", "Docker"]


def _by(column: str, words: dict[str, str] | list[str]) -> str:
    """SQL for the word that a column's value stands for."""
    of = words.items() if isinstance(words, dict) else enumerate(words)
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN '{w}'" for k, w in of) + " ELSE '' END"


def _matched(value: str, cases: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{n}'" for n, p in cases) + f" ELSE {otherwise} END"


PLACE = (("c_nationkey", CITIES), ("c_mktsegment", MODES))
TITLE = (("o_orderpriority", LEVELS), ("c_nationkey", NOUNS), ("c_mktsegment", FIELDS))
TEXT = (("c_nationkey", STACKS), ("c_mktsegment", {"MACHINERY": " Python", "BUILDING": " on AWS", "AUTOMOBILE": " and RAG", "HOUSEHOLD": " go"}))


def _spelt(parts: tuple) -> str:
    """SQL for a text of every order."""
    return f"SELECT o_orderkey, {' || '.join(_by(c, w) for c, w in parts)} AS t FROM orders JOIN customer ON o_custkey = c_custkey"


def _texts(spark: SparkSession, sf: str, parts: tuple) -> DataFrame:
    t = Tables(spark, sf)
    used = [c for c, _ in parts]
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), *(c for c in used if c[0] == "o"))
    df = orders.join(t.customer.select("c_custkey", *(c for c in used if c[0] == "c")), "c_custkey")
    return df.select("o_orderkey", F.concat(*(F.expr(_by(c, w)) for c, w in parts)).alias("t"))


_COUNTRIES = [(n, "(?i)" + p) for n, p in vocabulary.COUNTRIES] + [("US", rf"\b({'|'.join(vocabulary.STATES)})\b")]


@query(rf"""
WITH l AS ({_spelt(PLACE)}), f AS (SELECT *, t AS p, trim(regexp_extract(t, '^[^,|/]*')) AS first FROM l)
SELECT o_orderkey, CASE WHEN trim(p) <> '' THEN {_matched("p", _COUNTRIES)} END AS country, CASE WHEN first <> '' AND NOT regexp_matches(first, '(?i)remote|hybrid|onsite|anywhere|global') THEN first END AS city,
  CASE WHEN regexp_matches(lower(p), '\bhybrid\b') THEN 'hybrid' WHEN regexp_matches(lower(p), '\bremote\b') THEN 'remote' WHEN trim(p) <> '' THEN 'onsite' END AS remote_type FROM f
""")
def parse_location(spark, sf):
    return _texts(spark, sf, PLACE).select("o_orderkey", enrich.parse_location(F.col("t")).alias("p")).select("o_orderkey", "p.country", "p.city", "p.remote_type")


_INSIDE = _matched("t", [*(("out", "(?i)" + p) for p in vocabulary.OUT_TITLES), *(("in", "(?i)" + p) for p in vocabulary.IN_TITLES)])


@query(f"""WITH l AS ({_spelt(TITLE)}) SELECT o_orderkey, {_matched("lower(t)", vocabulary.SENIORITY)} AS seniority, {_matched("' ' || lower(t) || ' '", vocabulary.ROLES, "'Other'")} AS role, {_INSIDE} AS classification FROM l""")
def classify_titles(spark, sf):
    return _texts(spark, sf, TITLE).select("o_orderkey", enrich.seniority(F.col("t")).alias("seniority"), enrich.role(F.col("t")).alias("role"), enrich.classify_title(F.col("t"))["classification"].alias("classification"))


def _named(skill: str) -> str:
    return rf"regexp_matches(lower(t), '(^|[^a-z0-9]){re.escape(skill.lower())}([^a-z0-9]|$)')"


_SKILLS = ", ".join(f"CASE WHEN {_named(s)} THEN '{s}' END" for _, _, skills in vocabulary.CLUSTERS for s in skills)
_CLUSTERS = ", ".join(f"CASE WHEN {' OR '.join(map(_named, skills))} THEN '{c}' END" for c, _, skills in vocabulary.CLUSTERS)


@query(f"""WITH l AS ({_spelt(TEXT)}) SELECT o_orderkey, array_to_string(list_filter([{_SKILLS}], lambda x: x IS NOT NULL), ',') AS skills, array_to_string(list_filter([{_CLUSTERS}], lambda x: x IS NOT NULL), ',') AS clusters FROM l""")
def tag_skills(spark, sf):
    df = _texts(spark, sf, TEXT).select("o_orderkey", enrich.tag_skills(F.col("t")).alias("s"))
    return df.select("o_orderkey", F.array_join("s", ",").alias("skills"), F.array_join(enrich.skill_clusters(F.col("s")), ",").alias("clusters"))


# ---- aggregates

@query("""
SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
UNION ALL SELECT 'words', w, count(*) FROM (SELECT unnest(string_split(o_orderpriority, '-')) AS w FROM orders) GROUP BY 2
""")
def facet_counts(spark, sf):
    df = Tables(spark, sf).orders.select("o_orderstatus", "o_orderpriority", F.split("o_orderpriority", "-").alias("words"))
    return rel.facets(df, ["o_orderstatus", "o_orderpriority"], ["words"])


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 10) AS low, count(DISTINCT user_id) AS users,
  CAST(CASE WHEN count(*) = 0 THEN 0 ELSE floor(count(*) FILTER (value > 50) * 100.0 / count(*) + 0.5) END AS BIGINT) AS high_percent FROM events GROUP BY 1
""")
def conditional_counts(spark, sf):
    high = F.count_if(F.col("value") > 50)
    return Tables(spark, sf).events.groupBy("event_type").agg(F.count("*").alias("total"), high.alias("high"), F.count_if(F.col("value") <= 10).alias("low"), F.countDistinct("user_id").alias("users"), text.percent(high, F.count("*")).cast("long").alias("high_percent"))


@query("SELECT count(DISTINCT user_id) AS users, count(*) AS events FROM events")
def distinct_count(spark, sf):
    return Tables(spark, sf).events.agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("events"))


@query("SELECT p_brand AS brand, median(l_extendedprice) AS value, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 HAVING count(*) >= 5")
def median_by_group_having(spark, sf):
    t = Tables(spark, sf)
    df = t.lineitem.select("l_partkey", "l_extendedprice").join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand")), "l_partkey")
    return stats.median_by(df, "brand", "l_extendedprice", 5)


@query("SELECT p_type, count(*) AS n, min(p_retailprice) AS low, median(p_retailprice) AS median, max(p_retailprice) AS high FROM part GROUP BY 1")
def price_summary(spark, sf):
    return stats.spread(Tables(spark, sf).part.select("p_type", "p_retailprice"), "p_type", "p_retailprice")


@query("SELECT coalesce(median(o_totalprice), 0.0) AS none, (SELECT coalesce(median(o_totalprice), 0.0) FROM orders) AS whole FROM orders WHERE o_totalprice < 0")
def median_of_nothing(spark, sf):
    o = Tables(spark, sf).orders
    return stats.exact_median(o.where("o_totalprice < 0"), "o_totalprice", "none").crossJoin(F.broadcast(stats.exact_median(o, "o_totalprice", "whole")))


@query("SELECT o_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders_of, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY 1")
def nest_collect(spark, sf):
    return Tables(spark, sf).orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders_of"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"))


@query("""
WITH f AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS n FROM f)
SELECT user_id, array_to_string(list(event_type ORDER BY first_id), ',') AS stack FROM r WHERE n <= 3 GROUP BY 1
""")
def first_seen_stack(spark, sf):
    first = Tables(spark, sf).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    kept = first.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("first_id"))).where("n <= 3")
    return kept.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"]), ",").alias("stack"))


@query("SELECT p_partkey, list_min([CAST(x AS DOUBLE) FOR x IN regexp_extract_all(p_brand || ' ' || p_size, '[0-9]+')]) AS low, list_max([CAST(x AS DOUBLE) FOR x IN regexp_extract_all(p_brand || ' ' || p_size, '[0-9]+')]) AS high FROM part")
def row_min_max(spark, sf):
    nums = F.regexp_extract_all(F.concat_ws(" ", "p_brand", "p_size"), F.lit("[0-9]+"), F.lit(0)).cast("array<double>")
    return Tables(spark, sf).part.select("p_partkey", F.array_min(nums).alias("low"), F.array_max(nums).alias("high"))


# ---- order, rank, windows

@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 12")
def topk_customers(spark, sf):
    return rel.top(Tables(spark, sf).customer.select("c_custkey", "c_acctbal"), 12, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 5")
def topk_segments(spark, sf):
    return rel.top(rel.counts(Tables(spark, sf).customer, "c_mktsegment"), 5, F.desc("n"), F.asc("c_mktsegment"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 6")
def topk_parts(spark, sf):
    return rel.top(rel.counts(Tables(spark, sf).lineitem, "l_partkey"), 6, F.desc("n"), F.asc("l_partkey"))


@query("""
WITH c AS (SELECT CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY 1 LIMIT 3) THEN c_mktsegment ELSE 'Other' END AS label, count(*) AS n FROM customer GROUP BY 1)
SELECT label, n, row_number() OVER (ORDER BY label = 'Other', n DESC, label) AS place FROM c
""")
def pinned_last_order(spark, sf):
    t = Tables(spark, sf)
    named = rel.top(t.customer.select(F.col("c_mktsegment").alias("label")).distinct(), 3, F.asc("label")).withColumn("known", F.lit(True))
    df = t.customer.select(F.col("c_mktsegment").alias("label")).join(F.broadcast(named), "label", "left").select(F.when(F.col("known"), F.col("label")).otherwise("Other").alias("label"))
    order = (F.col("label") == "Other", F.desc("n"), F.col("label"))
    return rel.counts(df, "label").withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top50_rank(spark, sf):
    return rel.ranked(Tables(spark, sf).orders.select("o_orderkey", "o_totalprice"), 50, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "rank")


@query("WITH t AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT o.o_orderkey, t.rank FROM orders o LEFT JOIN t USING (o_orderkey)")
def rank_left_join(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice")
    return o.select("o_orderkey").join(rel.ranked(o, 50, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "rank"), "o_orderkey", "left")


@query("WITH c AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, n / greatest(1, max(n) OVER ()) AS share FROM c")
def bar_share(spark, sf):
    return rel.share_of_max(rel.counts(Tables(spark, sf).part, "p_brand"), "n")


@query("""
WITH m AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS b FROM conversations),
i AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM m)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, count(*) AS turns, CAST(sum(n) AS BIGINT) AS chars FROM i GROUP BY 1, 2
""")
def islands(spark, sf):
    w = W.partitionBy("conv_id").orderBy("turn")
    df = Tables(spark, sf).conversations.select("conv_id", "turn", "role", F.char_length("text").alias("n")).withColumn("b", ~F.coalesce(F.col("role") == F.lag("role").over(w), F.lit(False)))
    return rel.islands(df, ["conv_id"], F.col("turn"), F.col("b")).groupBy("conv_id", F.col("island").cast("long")).agg(F.min("role").alias("role"), F.count("*").alias("turns"), F.sum("n").cast("long").alias("chars"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT doc_id, pos, trim(line) AS line, regexp_matches(trim(line), '^(der|the|les)\\b') AS bullet FROM l WHERE trim(line) <> ''),
s AS (SELECT *, CASE WHEN bullet AND lag(bullet) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS b FROM t),
r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM s)
SELECT doc_id, CAST(block AS BIGINT) AS block, bool_and(bullet) AS is_list, count(*) AS lines FROM r GROUP BY 1, 2
""".replace("\\\\", "\\"))
def line_blocks(spark, sf):
    lines = Tables(spark, sf).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.trim("line").alias("line")).where("line <> ''")
    df = lines.withColumn("bullet", F.col("line").rlike(r"^(der|the|les)(?![A-Za-z0-9_])"))
    w = W.partitionBy("doc_id").orderBy("pos")
    df = df.withColumn("b", ~(F.col("bullet") & F.coalesce(F.lag("bullet").over(w), F.lit(False))))
    return rel.islands(df, ["doc_id"], F.col("pos"), F.col("b"), "block").groupBy("doc_id", F.col("block").cast("long")).agg(F.bool_and("bullet").alias("is_list"), F.count("*").alias("lines"))


# ---- joins

@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND c_acctbal > 0")
def inner_joins(spark, sf):
    t = Tables(spark, sf)
    o = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name", "c_nationkey").join(F.broadcast(t.nation.select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey IS NOT NULL)), ','), '') AS orders_of FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_default(spark, sf):
    t = Tables(spark, sf)
    lists = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    return rel.with_default_lists(t.customer.select("c_custkey"), lists, "c_custkey", "ks").select("c_custkey", F.array_join(F.col("ks").cast("array<string>"), ",").alias("orders_of"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, sf):
    t = Tables(spark, sf)
    return t.customer.select("c_custkey", "c_name").join(t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_join(spark, sf):
    t = Tables(spark, sf)
    some = t.orders.where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(some, "c_custkey", "left_anti")


@query("SELECT a.r_name, b.r_name AS other FROM region a, region b WHERE a.r_name <> b.r_name")
def theta_self(spark, sf):
    return rel.other_pairs(Tables(spark, sf).region.select("r_name"), "r_name")


@query("""
WITH d(o_orderpriority, place) AS (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4), ('5-LOW', 5), ('6-NONE', 6))
SELECT d.o_orderpriority, CAST(place AS INTEGER) AS place, count(o_orderkey) AS n FROM d LEFT JOIN orders USING (o_orderpriority) GROUP BY 1, 2
""")
def zero_filled_dim(spark, sf):
    dim = small(spark, [(p, k) for k, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"), 1)], "o_orderpriority string, place int")
    return rel.zero_filled(dim, rel.counts(Tables(spark, sf).orders, "o_orderpriority"), "o_orderpriority")


@query("WITH d(w) AS (VALUES ('URGENT'), ('LOW'), ('HIGH'), ('NEVER')), o AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w FROM orders) SELECT d.w, count(o_orderkey) AS n, coalesce(min(o_orderkey), -1) AS first_key FROM d LEFT JOIN o USING (w) GROUP BY 1")
def containment_join(spark, sf):
    items = Tables(spark, sf).orders.select("o_orderkey", F.split("o_orderpriority", "-").alias("ws"))
    got = rel.containing(small(spark, [("URGENT",), ("LOW",), ("HIGH",), ("NEVER",)], "w string"), items, "w", "ws")
    return got.groupBy("w").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.min("o_orderkey"), F.lit(-1)).alias("first_key"))


RATES = [("GERMANY", "EUR", 1.08), ("FRANCE", "EUR", 1.08), ("UNITED KINGDOM", "GBP", 1.27), ("CANADA", "CAD", 0.73), ("INDIA", "INR", 0.012)]


@query(f"""
WITH fx(n_name, cur, rate) AS (VALUES {", ".join(f"('{n}', '{c}', CAST({r} AS DOUBLE))" for n, c, r in RATES)}),
m AS (SELECT c_custkey, (c_acctbal + c_acctbal) / 2 * CASE c_mktsegment WHEN 'BUILDING' THEN 12.0 WHEN 'MACHINERY' THEN 260.0 ELSE 1.0 END * coalesce(rate, 1.0) AS annual FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN fx USING (n_name))
SELECT c_custkey, annual FROM m WHERE annual BETWEEN 10000 AND 2000000
""")
def currency_period_normalize(spark, sf):
    t = Tables(spark, sf)
    df = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    df = rel.lookup(df, small(spark, [(n, c) for n, c, _ in RATES], "n_name string, cur string"), "n_name", "cur", F.lit("USD"))
    period = F.when(F.col("c_mktsegment") == "BUILDING", "month").when(F.col("c_mktsegment") == "MACHINERY", "day").otherwise("year")
    live = F.create_map(*(F.lit(x) for kv in {c: r for _, c, r in RATES}.items() for x in kv))
    return df.select("c_custkey", enrich.midpoint_usd(F.col("c_acctbal"), F.col("c_acctbal"), F.col("cur"), period, live).alias("annual")).where("annual IS NOT NULL")


@query("SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN 0.0 WHEN c_acctbal * 12.0 * 1.27 > 2000000 THEN 0.0 ELSE c_acctbal * 12.0 * 1.27 END AS rank_pay FROM customer")
def pay_rank(spark, sf):
    none = F.lit(None).cast("double")
    return Tables(spark, sf).customer.select("c_custkey", enrich.pay_rank(F.col("c_acctbal"), none, F.lit("gbp"), F.lit("month")).alias("rank_pay"))


def _shown(n: str) -> str:
    return f"CASE WHEN {n} >= 1000 THEN CAST(CAST(floor({n} / 1000 + 0.5) AS BIGINT) AS VARCHAR) || 'k' ELSE regexp_replace(CAST({n} AS VARCHAR), '\\.0$', '') END"


@query(f"""
WITH r AS (SELECT o_orderkey, o_totalprice AS p, o_totalprice / 100 AS low, CASE o_orderkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'GBP' WHEN 2 THEN 'EUR' ELSE 'CHF' END AS cur FROM orders)
SELECT o_orderkey, CASE WHEN p <> 0 THEN CASE cur WHEN 'USD' THEN '$' WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE 'CHF ' END || {_shown("low")} || '–' || {_shown("p")} || '/yr' END AS label FROM r
""")
def format_pay(spark, sf):
    p, k = F.col("o_totalprice"), F.col("o_orderkey") % 4
    cur = F.when(k == 0, "USD").when(k == 1, "GBP").when(k == 2, "EUR").otherwise("CHF")
    return Tables(spark, sf).orders.select("o_orderkey", enrich.format_pay(p / 100, p, cur, F.lit("year")).alias("label"))


# ---- sets

@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def keep_first_dedupe(spark, sf):
    return rel.keep_first(Tables(spark, sf).events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.col("event_id")])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS place FROM events GROUP BY 1")
def keep_last_dedupe(spark, sf):
    return rel.keep_last_in_first_place(Tables(spark, sf).events.select("user_id", "event_type", "event_id"), ["user_id"], F.col("event_id"))


@query("""
SELECT '/' AS path UNION ALL SELECT '/regions/' || lower(r_name) FROM region UNION ALL SELECT DISTINCT '/nations/' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT '/suppliers/' || s_suppkey FROM supplier
""")
def union_distinct_paths(spark, sf):
    t = Tables(spark, sf)
    nations = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name").distinct()
    parts = [spark.range(1).select(F.lit("/").alias("path")), t.region.select(F.concat(F.lit("/regions/"), F.lower("r_name"))), nations.select(F.concat(F.lit("/nations/"), "n_name")), t.supplier.select(F.concat(F.lit("/suppliers/"), F.col("s_suppkey").cast("string")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT event_id, ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS is_new FROM events")
def rolling_7d_flag(spark, sf):
    e = Tables(spark, sf).events.select("event_id", "ts")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_id", (F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("is_new"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))), ' ') AS words FROM part")
def array_union(spark, sf):
    return Tables(spark, sf).part.select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.concat(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")))), " ").alias("words"))


# ---- state: old rows are orders not in process, the batch those in process or urgent, at a changed price; every order is in one of them

_OLD = "SELECT o_orderkey AS id, o_custkey AS source_id, o_orderstatus AS title, o_totalprice AS price, o_custkey % 5 = 0 AS is_closed, o_custkey % 7 = 0 AS is_direct, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 100 END AS last_seen_at, sha256(o_orderstatus || o_orderpriority) AS content_hash FROM orders WHERE o_orderstatus <> 'P'"
_BATCH = "SELECT o_orderkey AS id, o_custkey AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS title, o_totalprice * 2 AS price, CAST(1000 AS BIGINT) AS last_seen_at, sha256(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END || o_orderpriority) AS content_hash FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority < '3'"


def _old(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seen = F.when(k % 11 == 0, None).otherwise(k % 100)
    return t.orders.where("o_orderstatus <> 'P'").select(k.alias("id"), c.alias("source_id"), F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("price"), (c % 5 == 0).alias("is_closed"), (c % 7 == 0).alias("is_direct"), seen.alias("last_seen_at"), text.content_hash(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("content_hash"))


def _batch(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 2 == 0, F.concat("o_orderstatus", F.lit("!"))).otherwise(F.col("o_orderstatus"))
    return t.orders.where("o_orderstatus = 'P' OR o_orderpriority < '3'").select(k.alias("id"), F.col("o_custkey").alias("source_id"), title.alias("title"), (F.col("o_totalprice") * 2).alias("price"), F.lit(1000).cast("long").alias("last_seen_at"), text.content_hash(title, F.col("o_orderpriority")).alias("content_hash"))


@query(f"""
WITH o AS ({_OLD}), b AS ({_BATCH})
SELECT coalesce(o.id, b.id) AS id, coalesce(o.source_id, b.source_id) AS source_id, CASE WHEN b.id IS NULL THEN o.title ELSE b.title END AS title, CASE WHEN b.id IS NULL THEN o.price ELSE b.price END AS price,
  CASE WHEN b.id IS NULL THEN o.is_closed ELSE false END AS is_closed, CASE WHEN o.id IS NULL THEN false ELSE o.is_direct END AS is_direct, CASE WHEN b.id IS NULL THEN o.last_seen_at ELSE b.last_seen_at END AS last_seen_at
FROM o FULL JOIN b ON o.id = b.id
""")
def upsert(spark, sf):
    t = Tables(spark, sf)
    fresh = _batch(t).withColumns({"is_closed": F.lit(False), "is_direct": F.lit(False)})
    return state.upsert(_old(t), fresh, "id", ["title", "price", "last_seen_at", "content_hash"], {"is_closed": F.lit(False)}).drop("content_hash")


@query(f"WITH o AS ({_OLD}), b AS ({_BATCH}) SELECT b.id, NOT coalesce(o.content_hash = b.content_hash AND NOT o.is_closed, false) AS changed FROM b LEFT JOIN o ON o.id = b.id")
def change_gate(spark, sf):
    t = Tables(spark, sf)
    return state.change_gate(_batch(t), _old(t)).select("id", "changed")


@query(f"WITH o AS ({_OLD}), b AS ({_BATCH}) SELECT o.id, CASE WHEN b.id IS NULL THEN o.last_seen_at ELSE 1000 END AS last_seen_at, CASE WHEN b.id IS NULL THEN o.is_closed ELSE false END AS is_closed FROM o LEFT JOIN b ON o.id = b.id")
def mark_seen(spark, sf):
    t = Tables(spark, sf)
    return state.mark_seen(_old(t), _batch(t), F.lit(1000).cast("long")).select("id", "last_seen_at", "is_closed")


@query(f"WITH o AS ({_OLD}) SELECT id, is_closed OR (source_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND NOT is_direct AND (last_seen_at IS NULL OR last_seen_at < 50)) AS is_closed FROM o")
def close_stale(spark, sf):
    t = Tables(spark, sf)
    polled = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return state.close_stale(_old(t), polled, F.lit(50)).select("id", "is_closed")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey AS job_id, l_partkey AS skill_id FROM lineitem WHERE l_linenumber <= 2), p AS (SELECT DISTINCT l_orderkey AS job_id FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT DISTINCT l_orderkey AS job_id, l_suppkey AS skill_id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)
SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.job_id = o.job_id) UNION ALL SELECT * FROM b
""")
def replace_bridge(spark, sf):
    line = Tables(spark, sf).lineitem
    old = line.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("skill_id")).distinct()
    processed = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job_id"))
    new = line.where("l_returnflag = 'R' AND l_quantity > 25").select(F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("skill_id"))
    return state.replace_bridge(old, processed, new, "job_id")


@query("SELECT p_partkey, p_name FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, upper(p_name) FROM part WHERE p_size > 25")
def insert_absent(spark, sf):
    part = Tables(spark, sf).part
    return state.insert_absent(part.where("p_size <= 25").select("p_partkey", "p_name"), part.where("p_size > 15").select("p_partkey", F.upper("p_name").alias("p_name")), "p_partkey")


@query("SELECT s_suppkey AS company_id, s_name AS name, coalesce(NULLIF(CASE WHEN s_suppkey % 2 = 0 THEN s_name END, ''), lower(s_name)) AS ats_token, n_nationkey AS source_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3")
def poll_targets(spark, sf):
    t = Tables(spark, sf)
    companies = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("slug"), F.lit(None).cast("string").alias("domain"), F.lit("x").alias("ats_provider"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("ats_token"), "s_nationkey")
    sources = t.nation.join(companies.select("s_nationkey", F.col("id").alias("company_id")), F.col("n_nationkey") == F.col("s_nationkey")).select("company_id", F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") < 3, "active").otherwise("off").alias("status"))
    return state.poll_targets(companies.drop("s_nationkey"), sources).select("company_id", "name", "ats_token", "source_id")


@query("SELECT o_orderpriority AS dedup_key, min(o_orderkey) AS id FROM orders GROUP BY 1")
def cross_source_duplicates(spark, sf):
    jobs = Tables(spark, sf).orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("dedup_key"))
    return rel.cross_source_duplicates(jobs, order=[F.col("id")]).select("dedup_key", "id")


# ---- pages

@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || '  ' || p_type), 'an') AND p_brand = 'Brand#11'")
def search_filter(spark, sf):
    part = Tables(spark, sf).part
    brand = "Brand#11"
    empty = F.array().cast("array<string>")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    jobs = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company_name"), empty.alias("skills"), F.col("p_type").alias("location_raw"), F.lower("p_name").alias("normalized_title"),
                       F.col("p_brand").alias("country"), none.alias("seniority"), number.alias("salary_min"), number.alias("salary_max"), none.alias("salary_currency"), none.alias("salary_period"), F.col("p_partkey").alias("ord"))
    return pages.search(jobs, text=" AN ", country=brand).select(F.col("id").alias("p_partkey"))


@query("""SELECT c_custkey, CAST(json_object('name', c_name, 'n', CAST(c_nationkey AS INTEGER)) AS VARCHAR) AS json FROM customer""")
def json_payload(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"), F.lit(None).cast("string").alias("gone"))).alias("json"))


# ---- feeds and structured data, over payloads built from the tables

@query("SELECT 'board' AS slug, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, 'a & b' || chr(10) || chr(10) || '• ' || o_orderstatus AS description_text, 'u' || o_orderkey AS apply_url, o_orderstatus AS location_raw, CAST(o_orderdate AS TIMESTAMP) AS posted_at FROM orders")
def feed_greenhouse(spark, sf):
    job = F.struct(
        F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")).alias("title"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("absolute_url"), F.struct(F.col("o_orderstatus").alias("name")).alias("location"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_published"), F.concat(F.lit("&lt;p&gt;a &amp;amp; b&lt;/p&gt;&lt;li&gt;"), "o_orderstatus").alias("content"),
    )
    page = Tables(spark, sf).orders.select(F.lit("board").alias("slug"), F.lit(0).alias("query"), F.lit(0).alias("page"), F.lit("").alias("url"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("body"))
    got = feeds.greenhouse(page)
    return got.select("slug", "external_id", "title", "description_text", "apply_url", "location_raw", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE o_orderstatus WHEN 'F' THEN 'remote' WHEN 'O' THEN 'onsite' END AS remote_type, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'h' END AS apply_url FROM orders WHERE o_orderkey % 5 <> 0")
def feed_lever(spark, sf):
    k = F.col("o_orderkey")
    job = F.struct(k.cast("string").alias("id"), F.lit("t").alias("text"), F.when(k % 5 != 0, F.lit("h")).alias("hostedUrl"), F.when((k % 2 == 0) & (k % 5 != 0), F.lit("a")).alias("applyUrl"), F.when(F.col("o_orderstatus") == "F", "Remote").when(F.col("o_orderstatus") == "O", "on-site").otherwise("unspecified").alias("workplaceType"))
    page = Tables(spark, sf).orders.select(F.lit("b").alias("slug"), F.lit(0).alias("query"), F.lit(0).alias("page"), F.lit("").alias("url"), F.to_json(F.array(job)).alias("body"))
    return feeds.lever(page).select("external_id", "remote_type", "apply_url")


@query("SELECT p_partkey, p_name AS title, p_brand || CASE WHEN p_size % 2 = 0 THEN ', ' || p_type ELSE '' END AS location, CAST(p_size AS VARCHAR) AS identifier FROM part WHERE p_size % 3 <> 0")
def json_ld(spark, sf):
    place = F.struct(F.struct(F.col("p_brand").alias("addressLocality"), F.col("p_brand").alias("addressRegion"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("addressCountry")).alias("address"))
    node = F.struct(F.when(F.col("p_size") % 3 != 0, "JobPosting").otherwise("Thing").alias("@type"), F.concat(F.lit(" "), "p_name").alias("title"), F.array(place).alias("jobLocation"), F.struct(F.col("p_size").alias("value")).alias("identifier"))
    html = F.concat(F.lit("<p><script type='application/ld+json'>{oops</script><SCRIPT id=1 type=\"application/ld+json\">"), F.to_json(F.struct(F.array(node).alias("@graph"))), F.lit("</SCRIPT>"))
    found = Tables(spark, sf).part.select("p_partkey", F.explode(jsonld.job_postings(html)).alias("j"))
    return found.select("p_partkey", "j.title", "j.location", "j.identifier")


@query("""
WITH j AS (SELECT o_orderkey AS id, o_orderpriority AS page, o_totalprice AS lo, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS hi FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice <> 0),
m AS (SELECT page, CASE WHEN hi IS NULL THEN lo ELSE (lo + hi) / 2 END AS mid FROM j)
SELECT id, count(mid) AS n, min(mid) AS low, median(mid) AS median, max(mid) AS high FROM (VALUES ('1-URGENT'), ('5-LOW'), ('none')) p(id) LEFT JOIN m ON page = id GROUP BY 1
""")
def salary_pages(spark, sf):
    k = F.col("o_orderkey")
    jobs = Tables(spark, sf).orders.select(F.array("o_orderpriority", F.lit("other")).alias("clusters"), F.col("o_totalprice").alias("salary_min"), F.when(k % 2 == 0, F.col("o_totalprice") * 2).alias("salary_max"), F.when(F.col("o_orderstatus") == "P", "EUR").when(k % 3 == 0, "USD").alias("salary_currency"), F.when(k % 7 == 0, "year").alias("salary_period"))
    return stats.salary_pages(small(spark, [("1-URGENT",), ("5-LOW",), ("none",)], "id string"), jobs).select("id", "n", "low", "median", "high")


@query("SELECT event_id, true AS in_scope, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0.6) AS confidence, upper(event_type) AS country FROM events")
def scorer_record(spark, sf):
    raw = F.to_json(F.struct(F.lit(True).alias("inScope"), F.get_json_object("props", "$.k").cast("double").alias("confidence"), F.concat(F.lit(" "), "event_type").alias("country")))
    return Tables(spark, sf).events.select("event_id", enrich.scorer_record(raw).alias("x")).select("event_id", "x.in_scope", "x.confidence", "x.country")


@query("""
WITH c AS (SELECT o_custkey AS slug, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS with_pay FROM orders GROUP BY 1),
s AS (SELECT o_custkey AS slug, o_orderpriority AS skill, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2)
SELECT slug, c.n, with_pay, array_to_string(list(skill ORDER BY first_key), ',') AS stack FROM customer JOIN c ON c_custkey = slug JOIN s USING (slug) GROUP BY 1, 2, 3
""")
def company_pages(spark, sf):
    t = Tables(spark, sf)
    jobs = t.orders.select(F.col("o_custkey").alias("company_slug"), F.col("o_orderkey").alias("ord"), F.array("o_orderpriority").alias("skills"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("salary_min"))
    return pages.company_pages(t.customer.select(F.col("c_custkey").alias("slug")), jobs).select("slug", "n", "with_pay", F.array_join("stack", ",").alias("stack"))


@query("""
WITH j AS (SELECT o_orderkey, unnest(list_distinct(string_split(o_orderpriority, '-'))) AS id FROM orders), p AS (SELECT id, o_orderkey, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS position FROM j)
SELECT t.id, o_orderkey AS job_id, position FROM (VALUES ('URGENT'), ('LOW'), ('NEVER')) t(id) LEFT JOIN p ON p.id = t.id
""")
def topic_positions(spark, sf):
    jobs = Tables(spark, sf).orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("ord"), F.split("o_orderpriority", "-").alias("clusters"))
    return pages.topic_pages(small(spark, [("URGENT",), ("LOW",), ("NEVER",)], "id string"), jobs).select("id", "job_id", "position")


# ---- labels, gates, small scalars, counters

@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Remote' WHEN 'O' THEN 'On-site' END AS remote, CASE o_orderkey % 3 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Mid' END AS level FROM orders")
def labels_of(spark, sf):
    kind = F.when(F.col("o_orderstatus") == "F", "remote").when(F.col("o_orderstatus") == "O", "onsite").otherwise("x")
    level = F.when(F.col("o_orderkey") % 3 == 0, "senior").when(F.col("o_orderkey") % 3 == 1, "mid")
    return Tables(spark, sf).orders.select("o_orderkey", enrich.label(kind, vocabulary.REMOTE_LABELS).alias("remote"), enrich.label(level, vocabulary.SENIORITY_LABELS).alias("level"))


@query(f"SELECT o_orderkey FROM ({_spelt(TITLE)}) WHERE regexp_matches(t, '(?i){vocabulary.TECH_TITLE}')")
def tech_gate(spark, sf):
    return _texts(spark, sf, TITLE).where(feeds.tech(F.col("t"))).select("o_orderkey")


@query("""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' ') AS shown FROM pages
""")
def display_entities(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.display_text(F.col("html")).alias("shown"))


@query("SELECT page_id, url_encode(url) AS encoded FROM pages")
def uri_encoding(spark, sf):
    return Tables(spark, sf).pages.select("page_id", text.uri_component(F.col("url")).alias("encoded"))


@query("SELECT c_custkey, CAST(floor(c_acctbal / 1000 + 0.5) AS BIGINT) AS k, CAST(CASE WHEN c_nationkey = 0 THEN 0 ELSE floor(c_custkey * 100.0 / c_nationkey + 0.5) END AS BIGINT) AS pct FROM customer")
def rounding(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", text.thousands(F.col("c_acctbal")).cast("long").alias("k"), text.percent(F.col("c_custkey").cast("double"), F.col("c_nationkey").cast("double")).cast("long").alias("pct"))


@query(f"WITH o AS ({_OLD}), b AS ({_BATCH}), g AS (SELECT NOT coalesce(o.content_hash = b.content_hash AND NOT o.is_closed, false) AS changed FROM b LEFT JOIN o ON o.id = b.id) SELECT count(*) AS fetched, count(*) FILTER (changed) AS processed, count(*) FILTER (NOT changed) AS unchanged FROM g")
def run_counters(spark, sf):
    t = Tables(spark, sf)
    return state.change_gate(_batch(t), _old(t)).agg(F.count("*").alias("fetched"), F.count_if("changed").alias("processed"), F.count_if(~F.col("changed")).alias("unchanged"))


@query("""
SELECT '  <url><loc>https://site' || path || '</loc></url>' AS value FROM (SELECT '/' AS path UNION ALL SELECT '/companies/' || o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) UNION ALL SELECT '/jobs/' || o_orderkey FROM orders
  UNION ALL SELECT '/a-jobs' UNION ALL SELECT '/salaries/a')
UNION ALL SELECT '<?xml version="1.0" encoding="UTF-8"?>' UNION ALL SELECT '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' UNION ALL SELECT '</urlset>'
""")
def sitemap(spark, sf):
    jobs = Tables(spark, sf).orders.select(F.col("o_custkey").cast("string").alias("company_slug"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderkey").cast("string").alias("slug"))
    return pages.sitemap(pages.sitemap_paths(jobs, small(spark, [("a", "a-jobs", "A")], "id string, path string, label string")), "https://site")


_ROLE = _matched("' ' || lower(p_name) || ' '", vocabulary.ROLES, "'Other'")


@query(f"SELECT p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_name || ' x ' || p_type) AS search, {_ROLE} AS role, 'x' AS first_skills FROM part")
def search_cards(spark, sf):
    part = Tables(spark, sf).part
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    jobs = part.select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("company_name"), F.array("p_name", F.lit("x")).alias("skills"), F.col("p_type").alias("location_raw"), F.lower("p_name").alias("normalized_title"),
                       number.alias("salary_min"), number.alias("salary_max"), none.alias("salary_currency"), none.alias("salary_period"))
    return pages.cards(jobs).select("p_partkey", "search", "role", F.get("card_skills", 1).alias("first_skills"))
