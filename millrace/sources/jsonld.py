"""Job postings in the ld+json blocks of web pages, as one expression per page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import present, trim

BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
_NODE = "variant"


def _is(v: Column, kind: str) -> Column:
    """Whether a variant holds an ARRAY, an OBJECT, a STRING or a number."""
    name = F.schema_of_variant(v)
    if kind == "NUMBER":
        return F.coalesce(name.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.lit(False))
    return F.coalesce(name.startswith(kind), F.lit(False))


def _text(v: Column, path: str) -> Column:
    own = F.try_variant_get(v, path, _NODE)
    return F.when(_is(own, "STRING"), F.try_variant_get(v, path, "string"))


def timestamp(c: Column) -> Column:
    """A point in time from ISO text, with or without zone; null if it is none. The session's zone must be UTC."""
    return F.try_to_timestamp(c)


def _location(v: Column) -> Column:
    place = F.try_variant_get(v, "$.jobLocation", _NODE)
    first = F.when(_is(place, "ARRAY"), F.try_variant_get(place, "$[0]", _NODE)).otherwise(place)
    address = F.try_variant_get(first, "$.address", _NODE)
    a = F.when(_is(address, "ARRAY"), F.try_variant_get(address, "$[0]", _NODE)).otherwise(address)
    parts = F.array(*(present(_text(a, f"$.{k}")) for k in ("addressLocality", "addressRegion", "addressCountry")))
    whole = present(F.array_join(F.array_distinct(F.filter(parts, lambda x: x.isNotNull())), ", "))
    return F.when(_is(first, "OBJECT"), F.when(_is(a, "OBJECT"), whole).when(_is(address, "STRING"), _text(first, "$.address")))


def _identifier(v: Column) -> Column:
    own = F.try_variant_get(v, "$.identifier", _NODE)
    value = F.try_variant_get(own, "$.value", _NODE)
    plain = F.when(_is(value, "STRING") | _is(value, "NUMBER"), F.try_variant_get(own, "$.value", "string"))
    return F.when(_is(own, "STRING"), F.try_variant_get(v, "$.identifier", "string")).when(_is(own, "OBJECT"), plain)


def _is_posting(v: Column) -> Column:
    kind = F.try_variant_get(v, "$['@type']", _NODE)
    names = F.when(_is(kind, "ARRAY"), F.try_variant_get(v, "$['@type']", "array<variant>")).otherwise(F.array(kind))
    return _is(v, "OBJECT") & F.exists(names, lambda t: F.coalesce(_is(t, "STRING") & F.contains(F.try_variant_get(t, "$", "string"), F.lit("JobPosting")), F.lit(False)))


def job_postings(html: Column) -> Column:
    """array<struct<title, description_html, date_posted, location, url, identifier>>: blocks that aren't JSON are skipped; a block
    may be one object, an array or an @graph."""
    blocks = F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(BLOCK), F.lit(1)), lambda b: F.try_parse_json(trim(b))), lambda v: v.isNotNull())

    def nodes(v: Column) -> Column:
        graph = F.try_variant_get(v, "$['@graph']", _NODE)
        return (
            F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
            .when(_is(graph, "ARRAY"), F.try_variant_get(v, "$['@graph']", "array<variant>"))
            .otherwise(F.array(v))
        )

    found = F.filter(F.flatten(F.transform(blocks, nodes)), _is_posting)
    return F.transform(
        found,
        lambda v: F.struct(
            trim(_text(v, "$.title")).alias("title"),
            _text(v, "$.description").alias("description_html"),
            timestamp(present(_text(v, "$.datePosted"))).alias("date_posted"),
            _location(v).alias("location"),
            _text(v, "$.url").alias("url"),
            _identifier(v).alias("identifier"),
        ),
    )
