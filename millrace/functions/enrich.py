"""What is inferred about a posting from its title, location, description and pay, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .text import matches, present, trim


def any_of(c: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(c, p, ignore_case)
    return out


def first_match(c: Column, cases: list[tuple[str, str]], ignore_case: bool = True, otherwise: str | None = None) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(otherwise).cast("string")
    for label, pattern in reversed(cases):
        out = F.when(matches(c, pattern, ignore_case), F.lit(label)).otherwise(out)
    return out


def verdict(label: str, confidence: float | Column, via: str) -> Column:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.struct(F.lit(label).alias("classification"), c.cast("double").alias("confidence"), F.lit(via).alias("via"))


def classify_title(title: Column, inside: list[str] = v.IN_TITLES, outside: list[str] = v.OUT_TITLES) -> Column:
    """struct(classification, confidence, via), null where the title decides nothing. Out goes before in."""
    return F.when(any_of(title, outside), verdict("out", v.OUT_CONFIDENCE, "heuristic")).when(any_of(title, inside), verdict("in", v.IN_CONFIDENCE, "heuristic"))


def cascade(heuristic: Column, in_scope: Column | None = None, confidence: Column | None = None) -> Column:
    """The heuristic's verdict, a second scorer's veto over ``in``, and its decision where the heuristic has none.

    Without a scorer (its Columns None, or null in a row) what is undecided is out, with low confidence."""
    default = verdict("out", v.DEFAULT_CONFIDENCE, "default")
    if in_scope is None:
        return F.coalesce(heuristic, default)
    sure = F.coalesce(confidence, F.lit(v.SCORER_CONFIDENCE))
    scored = F.when(in_scope, verdict("in", sure, "llm")).when(~in_scope, verdict("out", sure, "llm")).otherwise(default)
    veto = (heuristic["classification"] == "in") & F.coalesce(~in_scope & (sure >= v.VETO_CONFIDENCE), F.lit(False))
    return F.when(heuristic.isNull(), scored).when(veto, verdict("out", sure, "llm")).otherwise(heuristic)


def term_pattern(term: str) -> str:
    """A term as such, with no ASCII letter or digit on either side; the text is lower-cased before."""
    return rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])"


def tag_terms(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, in the order of the list. A plain search goes before each pattern, as most terms aren't there."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.array(*(F.when(F.contains(low, F.lit(t.lower())) & low.rlike(term_pattern(t)), F.lit(t)) for t in terms)), lambda x: x.isNotNull())


SKILLS = [s for _, _, skills in v.CLUSTERS for s in skills]
_CLUSTER = {s.lower(): c for c, _, skills in v.CLUSTERS for s in skills}


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def tag_skills(text: Column, scored: Column | None = None) -> Column:
    """Skills of the taxonomy in the text, then those a scorer named (any case), each once; names outside it are dropped."""
    found = tag_terms(text, SKILLS)
    if scored is None:
        return found
    known = F.filter(F.transform(F.coalesce(scored, F.array().cast("array<string>")), lambda s: F.try_element_at(_map({s.lower(): s for s in SKILLS}), F.lower(s))), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(found, known))


def skill_clusters(skills: Column) -> Column:
    """Cluster ids of the skills, each once, in the order first met."""
    return F.array_distinct(F.filter(F.transform(skills, lambda s: F.try_element_at(_map(_CLUSTER), F.lower(s))), lambda x: x.isNotNull()))


def seniority(title: Column) -> Column:
    return first_match(F.lower(title), v.SENIORITY, ignore_case=False)


def role(title: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    return first_match(padded, v.ROLES, ignore_case=False, otherwise="Other")


def country(location: Column) -> Column:
    return F.coalesce(first_match(location, v.COUNTRIES), F.when(matches(location, rf"\b({'|'.join(v.STATES)})\b"), F.lit("US")))


def remote_type(location: Column, declared: Column | None = None, hint: Column | None = None) -> Column:
    loc = F.lower(trim(F.coalesce(location, F.lit(""))))
    hinted = F.coalesce(hint, F.lit(False)) if hint is not None else F.lit(False)
    guess = F.when(matches(loc, r"\bhybrid\b"), "hybrid").when(hinted | matches(loc, r"\bremote\b"), "remote").when(loc != "", "onsite")
    return F.coalesce(present(declared), guess) if declared is not None else guess


def city(location: Column) -> Column:
    first = trim(F.split(trim(F.coalesce(location, F.lit(""))), "[,|/]")[0])
    return F.when((first != "") & ~matches(first, "remote|hybrid|onsite|anywhere|global", True), first)


def parse_location(location: Column, declared: Column | None = None, hint: Column | None = None) -> Column:
    loc = trim(F.coalesce(location, F.lit("")))
    return F.struct(remote_type(location, declared, hint).alias("remote_type"), F.when(loc != "", country(loc)).alias("country"), city(location).alias("city"))


def parse_salary(text: Column) -> Column:
    """struct(salary_min, salary_max, salary_currency, salary_period); null without a number of at least 1000."""
    t = F.replace(text, F.lit(","), F.lit(""))
    number = r"([0-9]+(?:\.[0-9]+)?)\s*([kKmM])?".replace(r"\s", r"[ \t-\r\xA0]")
    digits, suffix = (F.regexp_extract_all(t, F.lit(number), F.lit(k)) for k in (1, 2))
    factor = lambda s: F.when(F.lower(s) == "k", 1e3).when(F.lower(s) == "m", 1e6).otherwise(1.0)
    amounts = F.filter(F.zip_with(digits, suffix, lambda d, s: d.cast("double") * factor(s)), lambda n: n >= 1000)
    currency = F.when(matches(t, "£|gbp", True), "GBP").when(matches(t, "€|eur", True), "EUR").otherwise("USD")
    period = (
        F.when(matches(t, r"\b(hour|hourly|\/\s*hr|per hour)\b", True), "hour")
        .when(matches(t, r"\b(month|monthly|\/\s*mo)\b", True), "month")
        .when(matches(t, r"\b(day|daily|\/\s*day)\b", True), "day")
        .otherwise("year")
    )

    def of(found: Column) -> Column:  # a lambda's variable, so that the numbers are extracted once
        low, high = F.array_min(found), F.array_max(found)
        return F.when(F.size(found) > 0, F.struct(low.alias("salary_min"), F.when(high != low, high).alias("salary_max"), currency.alias("salary_currency"), period.alias("salary_period")))

    return F.when(F.coalesce(text, F.lit("")) != "", F.get(F.transform(F.array(amounts), of), 0))


def _factor(c: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(_map({k: float(x) for k, x in table.items()}), c), F.lit(1.0))


def _yearly(period: Column) -> Column:
    return _factor(F.coalesce(period, F.lit("year")), v.PERIODS)


def annual_usd(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """The top of the range as US dollars a year, at fixed rates; 0 without pay."""
    base = F.coalesce(high, low)
    return F.when(F.coalesce(base, F.lit(0)) == 0, F.lit(0.0)).otherwise(base * _yearly(period) * _factor(F.upper(F.coalesce(currency, F.lit("USD"))), v.RANK_FX))


def pay_rank(low: Column, high: Column, currency: Column, period: Column) -> Column:
    a = annual_usd(low, high, currency, period)
    return F.when(a > v.PAY_CEILING, F.lit(0.0)).otherwise(a)


def midpoint_usd(low: Column, high: Column, currency: Column, period: Column, live: Column | None = None) -> Column:
    """The middle of the range as US dollars a year, at live rates (map<string,double>) where known; null outside the plausible band."""
    lo, hi = F.coalesce(low, high), F.coalesce(high, low)
    cur = F.upper(F.coalesce(currency, F.lit("USD")))
    fixed = _factor(cur, v.RANK_FX)
    fx = fixed if live is None else F.coalesce(F.try_element_at(live, cur), fixed)
    annual = (lo + hi) / 2 * _yearly(period) * fx
    has = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    return F.when(has & annual.between(v.PAY_FLOOR, v.PAY_CEILING), annual)


def format_pay(low: Column, high: Column, currency: Column, period: Column) -> Column:
    from .text import number_text, rounded

    short = lambda n: F.when(n >= 1000, F.concat(rounded(n / 1000).cast("string"), F.lit("k"))).otherwise(number_text(n))
    cur = F.coalesce(currency, F.lit("USD"))
    sign = F.when(cur == "USD", "$").when(cur == "GBP", "£").when(cur == "EUR", "€").otherwise(F.concat(cur, F.lit(" ")))
    zero = F.lit(0)
    both = (F.coalesce(low, zero) != 0) & (F.coalesce(high, zero) != 0)
    span = F.when(both, F.concat(short(low), F.lit("–"), short(high))).otherwise(short(F.coalesce(low, high)))
    per = F.when(F.coalesce(present(period), F.lit("year")) == "year", "/yr").otherwise(F.concat(F.lit("/"), period))
    some = (F.coalesce(low, zero) != 0) | (F.coalesce(high, zero) != 0)
    return F.when(some & (annual_usd(low, high, currency, period) <= v.PAY_CEILING), F.concat(sign, span, per))


def label(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(_map(table), c)


def scorer_record(raw: Column) -> Column:
    """A scorer's JSON object as a struct with checked types: texts trimmed and non-empty, codes upper-case, a default confidence."""
    v_ = F.try_parse_json(raw)
    num = lambda k: F.try_variant_get(v_, f"$.{k}", "double")
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v_, f"$.{k}", "variant")) == "STRING", present(trim(F.try_variant_get(v_, f"$.{k}", "string"))))
    scope = F.try_variant_get(v_, "$.inScope", "boolean")
    out = F.struct(
        scope.alias("in_scope"), F.coalesce(num("confidence"), F.lit(v.SCORER_CONFIDENCE)).alias("confidence"), F.try_variant_get(v_, "$.skills", "array<string>").alias("skills"),
        text("seniority").alias("seniority"), F.upper(text("country")).alias("country"), text("city").alias("city"), text("remoteType").alias("remote_type"),
        num("salaryMin").alias("salary_min"), num("salaryMax").alias("salary_max"), F.upper(text("salaryCurrency")).alias("salary_currency"), text("salaryPeriod").alias("salary_period"),
    )
    return F.when(scope.isNotNull(), out)


