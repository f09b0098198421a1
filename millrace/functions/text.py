"""Text scalars as Columns: entities, markup, slugs, identifiers, hashes.

Patterns are written for ECMAScript semantics and translated: ``\\b`` and ``\\w`` are ASCII, ``\\s`` is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\t-\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = "A-Za-z0-9_"
_EDGE = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"

#: Entities decoded at ingest, and those decoded for display.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
DISPLAY_ENTITIES = ENTITIES | {"mdash": "—", "ndash": "–", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "hellip": "…"}


def regex(pattern: str, ignore_case: bool = False) -> str:
    """A Java pattern that matches what ``pattern`` matches in ECMAScript (without its u flag)."""
    out = pattern.replace(r"\b", _EDGE).replace(r"\s", f"[{SPACE}]")
    return f"(?iu){out}" if ignore_case else out


def matches(c: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(c.rlike(regex(pattern, ignore_case)), F.lit(False))


def trim(c: Column) -> Column:
    """Trims all Unicode white space, line ends and the byte-order mark."""
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def present(c: Column) -> Column:
    """Null for null and empty strings alike."""
    return F.nullif(c, F.lit(""))


def joined(sep: str, *parts: Column) -> Column:
    """The non-empty parts, joined; null if there are none."""
    return present(F.concat_ws(sep, *(present(p) for p in parts)))


def character(code: Column) -> Column:
    """The character of a code point; surrogates become U+FFFD."""
    safe = F.when(code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def decode_entities(c: Column, names: dict[str, str] = ENTITIES) -> Column:
    """Numeric and named entities decoded in one pass; unknown names and numbers beyond Unicode stay as they are."""
    pattern = r"&(#x?[0-9a-fA-F]+|[A-Za-z0-9_]+);"
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))

    def one(e: Column) -> Column:
        body = F.substring(e, F.lit(2), F.length(e) - 2)
        digits = F.regexp_extract(body, "^#([0-9]+)", 1)
        number = F.when(body.startswith("#x"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10)).when(digits != "", digits)
        code = number.try_cast("bigint")
        return F.when(body.startswith("#"), F.when(code.between(0, 0x10FFFF), character(code)).otherwise(e)).otherwise(F.coalesce(F.try_element_at(table, body), e))

    between = F.split(c, pattern)
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, F.transform(found, one), lambda p, e: F.concat(p, F.coalesce(e, F.lit("")))), "")


def strip_html(c: Column) -> Column:
    """Markup to text: line breaks, bullets and block ends become line ends, other tags a space, then entities, then blanks."""
    s = r"[ \t-\r]"
    for pattern, to in (
        (rf"(?i)<{s}*br{s}*/?>", "\n"),
        (rf"(?i)<{s}*li[^>]*>", "\n• "),
        (rf"(?i)</{s}*(?:p|div|ul|ol|h[1-6]|tr|section|article){s}*>", "\n\n"),
        (r"<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    c = decode_entities(c)
    for pattern, to in ((r"\xA0", " "), (r"[ \t\f\x0B]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def display_text(c: Column) -> Column:
    return F.replace(decode_entities(c, DISPLAY_ENTITIES), F.lit("\u00a0"), F.lit(" "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def normalized_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def short_hash(c: Column, length: int = 8) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, length)


def company_id(slug: Column) -> Column:
    return F.concat(F.lit("c_"), slugify(slug))


def source_id(company: Column, provider: Column) -> Column:
    return F.concat(company, F.lit("_"), provider)


def job_id(slug: Column, external_id: Column) -> Column:
    return F.concat(F.lit("j_"), short_hash(F.concat(slug, F.lit("|"), external_id), 16))


def job_slug(slug: Column, title: Column, external_id: Column) -> Column:
    return F.substring(F.concat(slugify(slug), F.lit("-"), slugify(title), F.lit("-"), short_hash(external_id, 6)), 1, 110)


def number_text(c: Column) -> Column:
    """A double as a script prints it: the fewest digits that read back as the same number, no trailing ``.0``, exponents only under 1e-6 and from 1e21 (subnormal numbers may show more digits)."""
    size = F.abs(c)
    tries = [F.format_string(f"%.{digits}e", c) for digits in (14, 15, 16)]
    short = F.coalesce(*(F.when(t.try_cast("double") == c, t) for t in tries))
    exponent = F.regexp_replace(short, r"\.?0*e([+-])0*", "e$1")
    fraction = F.regexp_replace(short.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    cases = [(c == 0, F.lit("0")), (F.isnan(c) | (size == float("inf")), c.cast("string")), ((size < 1e-6) | (size >= 1e21), exponent),
             (F.rint(c) != c, fraction), (size < 1e15, c.cast("long").cast("string"))]
    out = F.when(c.isNull(), None)
    for case, shown in cases:
        out = out.when(case, shown)
    return out.otherwise(short.try_cast("decimal(38,0)").cast("string"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts run together; null counts as empty, doubles print without ``.0``."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def dedup_key(slug: Column, title: Column, location: Column) -> Column:
    return F.concat(slug, F.lit("|"), normalized_title(title), F.lit("|"), F.lower(F.coalesce(location, F.lit(""))))


def uri_component(c: Column) -> Column:
    """Percent-encoding as scripts do it: a space is %20, and ! ~ ' ( ) stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def site_url(base: Column, path: Column) -> Column:
    """A path below a base, with exactly one slash between."""
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def rounded(c: Column) -> Column:
    """Half up towards plus infinity, also for negatives."""
    return F.floor(c + 0.5)


def thousands(c: Column) -> Column:
    return rounded(c / 1000)


def percent(n: Column, of: Column) -> Column:
    return F.when(of == 0, F.lit(0)).otherwise(rounded(F.try_divide(n * 100, of)))
