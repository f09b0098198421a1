"""Hand-derived rows for the scalar functions."""

import random
from decimal import Decimal
import pytest
from pyspark.sql import functions as F

from millrace.functions import enrich, text
from millrace.functions import vocabulary as v


def run(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(values)], f"k int, x {kind}")
    return [r.y for r in rows.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_entities(spark):
    got = run(spark, text.decode_entities, "&amp;lt; &bogus; &#8364;", "&#x41;&#65;&#X41;", "&#ab; &#12ab; &nbsp;|", "", None, "&&amp;;&lt", "&#128512;&#99999999;", "&#xD800;")
    assert got == ["&lt; &bogus; €", "AA&#X41;", "&#ab; \x0c  |", "", None, "&&amp;;&lt".replace("&amp;", "&"), "😀&#99999999;", "\ufffd"]
    assert run(spark, text.display_text, "a&mdash;b&nbsp;c&rsquo;") == ["a—b c’"]


def test_strip_html(spark):
    assert run(spark, text.strip_html, "<p>a</p><ul><li>b</li></ul>", "x<br/>y<BR>z", "<script>k</script>", "   a &lt;b&gt; ", "a</div></div></div>b", None) == ["a\n\n• b", "x\ny\nz", "k", "a <b>", "a\n\nb", None]


def test_slugs_and_ids(spark):
    assert run(spark, text.slugify, "capitalone:wd12:Capital_One", "--A  b--", "") == ["capitalone-wd12-capital-one", "a-b", ""]
    once = run(spark, text.slugify, "Ä x!y", "a--b")
    assert run(spark, text.slugify, *once) == once
    long = run(spark, lambda x: text.job_slug(F.lit("co"), x, F.lit("1")), "t" * 300)[0]
    assert len(long) == 110 and long.startswith("co-ttt")
    assert run(spark, text.normalized_title, " Sr. ML/AI Engineer ") == ["sr ml ai engineer"]


def test_numbers_print_like_scripts(spark):
    assert run(spark, text.number_text, 165000.0, 1e7, 0.5, 12.25, None, kind="double") == ["165000", "10000000", "0.5", "12.25", None]
    assert run(spark, text.rounded, 0.5, -0.5, 2.4, -2.6, kind="double") == [1, 0, 2, -3]
    assert run(spark, lambda x: text.percent(x, F.lit(0)), 3.0, kind="double") == [0]


def test_trim_and_boundaries(spark):
    assert run(spark, text.trim, " ﻿ a\n") == ["a"]
    assert run(spark, lambda c: text.matches(c, r"\brag\b", True), "ragé", "storage", "RAG!", None) == [True, False, True, False]
    assert run(spark, text.uri_component, "a b&c", "(it's)!~*-_.", "é+") == ["a%20b%26c", "(it's)!~*-_.", "%C3%A9%2B"]
    assert run(spark, lambda c: text.site_url(F.lit("https://x/y/"), c), "/a") == ["https://x/y/a"]


@pytest.mark.parametrize(
    ("shown", "want"),
    [
        ("$165K - $330K", (165000.0, 330000.0, "USD", "year")),
        ("£90,000–£120,000", (90000.0, 120000.0, "GBP", "year")),
        ("€80k per year", (80000.0, None, "EUR", "year")),
        ("$60 per hour", None),
        ("1.5m monthly", (1500000.0, None, "USD", "month")),
        ("neural 5000", (5000.0, None, "EUR", "year")),
        ("", None),
        (None, None),
    ],
)
def test_salary(spark, shown, want):
    got = run(spark, enrich.parse_salary, shown)[0]
    assert (tuple(got) if got else None) == want


def test_title_rules(spark):
    assert run(spark, enrich.seniority, "Staff Engineering Manager", "Internal Tools Engineer", "Sr. Dev", "VP Eng", "New Grad SWE", "Mid Engineer") == ["staff", None, "senior", "manager", "junior", None]
    got = run(spark, enrich.classify_title, "AI Sales Engineer, LLM", "Software Engineer", "LLM Engineer")
    assert [g and (g.classification, g.confidence) for g in got] == [("out", 0.9), None, ("in", 0.85)]
    assert run(spark, enrich.role, "senior data scientist", None, "GPT wrangler", "member of technical staff") == ["Data Scientist", "Other", "AI Engineer", "Research"]


def test_locations(spark):
    got = run(spark, enrich.parse_location, "London, Ontario, Canada", "Hamburg, DE", "Remote - US", "", None, "München", "Salem, or")
    assert [tuple(g) for g in got] == [("onsite", "GB", "London"), ("onsite", "US", "Hamburg"), ("remote", "US", None), (None, None, None), (None, None, None), ("onsite", "DE", "München"), ("onsite", None, "Salem")]
    declared = run(spark, lambda c: enrich.remote_type(c, F.lit("hybrid"), F.lit(True)), "Paris")
    assert declared == ["hybrid"] and run(spark, lambda c: enrich.remote_type(c, None, F.lit(True)), "") == ["remote"]


def test_skills(spark):
    assert run(spark, enrich.tag_skills, "cloud storage category", "RAG with C++", "go to market", None) == [[], ["RAG", "C++"], ["Go"], []]
    both = run(spark, lambda c: enrich.tag_skills(c, F.array(F.lit("python"), F.lit("cobol"), F.lit("rag"))), "RAG")
    assert both == [["RAG", "Python"]]
    assert run(spark, lambda c: enrich.skill_clusters(F.split(c, ",")), "RAG,Python,Qdrant") == [["rag", "language"]]
    assert len(enrich.SKILLS) == 57 and len(v.CLUSTERS) == 10


def test_pay(spark):
    row = lambda f, *a: spark.range(1).select(f(*(F.lit(x) for x in a)).alias("y")).first().y
    none = None
    assert row(lambda lo, hi, c, p: enrich.midpoint_usd(lo.cast("double"), hi.cast("double"), c, p, F.create_map(F.lit("GBP"), F.lit(1.27))), 100000.0, 200000.0, "GBP", "year") == 190500
    assert row(lambda lo, hi, c, p: enrich.midpoint_usd(lo, hi.cast("double"), c, p), 5000.0, none, "USD", "year") is None
    assert row(lambda lo, hi, c, p: enrich.pay_rank(lo, hi.cast("double"), c, p), 300000.0, none, "CHF", "month") == 0
    assert row(lambda lo, hi, c, p: enrich.annual_usd(lo, hi, c, p), 0.0, 0.0, "USD", "year") == 0
    assert row(lambda lo, hi, c, p: enrich.format_pay(lo, hi, c, p), 100000.0, 150000.0, "GBP", "year") == "£100k–150k/yr"
    assert row(lambda lo, hi, c, p: enrich.format_pay(lo, hi.cast("double"), c, p), 999.5, none, "CHF", "hour") is None
    assert row(lambda lo, hi, c, p: enrich.format_pay(lo, hi.cast("double"), c, p), 60.0, none, "USD", "hour") == "$60/hour"


def test_cascade(spark):
    rows = spark.createDataFrame([("LLM dev", None, None), ("LLM dev", False, 0.7), ("LLM dev", False, 0.69), ("Dev", True, 0.4), ("Dev", False, None), ("Dev", None, None), ("Sales LLM", True, 1.0)], "t string, s boolean, c double")
    got = [tuple(r.y) for r in rows.select(enrich.cascade(enrich.classify_title(F.col("t")), F.col("s"), F.col("c")).alias("y")).collect()]
    assert got == [("in", 0.85, "heuristic"), ("out", 0.7, "llm"), ("in", 0.85, "heuristic"), ("in", 0.4, "llm"), ("out", 0.6, "llm"), ("out", 0.3, "default"), ("out", 0.9, "heuristic")]
    alone = [tuple(r.y) for r in rows.select(enrich.cascade(enrich.classify_title(F.col("t"))).alias("y")).collect()]
    assert alone[3] == ("out", 0.3, "default")


def test_scorer_record(spark):
    got = run(spark, enrich.scorer_record, '{"inScope": true, "skills": ["RAG"], "country": " us ", "city": "", "salaryMin": 5, "seniority": 3}', "not json", None, '{"confidence": 1}')
    assert got[1:] == [None, None, None]
    r = got[0]
    assert (r.in_scope, r.confidence, r.skills, r.country, r.city, r.salary_min, r.seniority) == (True, 0.6, ["RAG"], "US", None, 5.0, None)


def test_number_text_is_the_shortest_round_trip(spark):
    def script(x):
        """From the shortest digits that Python prints, as a script lays them out."""
        sign, digits, exponent = Decimal(repr(abs(x))).normalize().as_tuple()
        digits, at = "".join(map(str, digits)), len(digits) + exponent
        if x == 0:
            return "0"
        if at > 21 or at < -5:
            shown = digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{at - 1:+d}"
        elif at <= 0:
            shown = "0." + "0" * -at + digits
        else:
            shown = digits.ljust(at, "0")[:at] + ("." + digits[at:] if digits[at:] else "")
        return ("-" if x < 0 else "") + shown

    rng = random.Random(4)
    values = [0.0, -0.0, 0.1 + 0.2, 2e-3, 1e-6, 9.5e-7, 2.5e-300, 1e21, 1e20, 123456789012345680000.0, 2.0**53, 2.0**63, 1.7976931348623157e308, 85000.55, 1e15 + 0.5, -12.5, 0.000001234567890123]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-9, 24) for _ in range(400)] + [round(rng.uniform(1, 10**6), rng.randrange(5)) for _ in range(400)]
    assert run(spark, text.number_text, *values, kind="double") == [script(x) for x in values]
    assert run(spark, text.number_text, float("nan"), float("-inf"), None, kind="double") == ["NaN", "-Infinity", None]
