"""Document fingerprints by Lempel-Ziv phrases (operator 4).

Method: each text is parsed into dictionary phrases (every phrase is the longest one already in the dictionary plus one
code point; a dictionary of ``MOST`` phrases begins anew, as in practical coders), the phrases are hashed, and the hash set's minima under ``SIZE`` random linear functions are the
signature. Two texts' likeness is the share of equal minima, an estimate of the Jaccard similarity of their phrase sets,
which rises and falls as one text helps to compress the other.

An edited text that shares its head with the text before it shares the parse of that head too, so the head is parsed once
and the dictionary is copied (``parse_pair``).

``compare_next`` needs each document's successor by id. Documents are dealt to ranges of (id, text hash): bounds are quantiles of the
ids, and an id that holds several quantiles is cut again by hash, so a hot id (all null ids, say) spreads over as many ranges. The first document of each range is also sent, marked, to the end
of the range before it. So every text is shuffled once, each partition is streamed in order, and nothing is
gathered in one place. The lists of bounds have one entry a partition.

Defined cases: null or empty text has no phrases; its fingerprint is that of the empty set, like only to another of the same
kind (likeness 1) and unlike any other (0). Ids that are null come first; rows of equal id are ordered by the 64-bit hash of their text, and rows equal in both are each other's successors and stay in one partition. A very long
text is parsed whole, with at most two dictionaries of MOST phrases, 8 bytes a phrase end, and its phrases hashed ``BLOCK`` code points at a time. A
table of one document is its own successor. Other columns pass through ``fingerprint``, one of that name is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Rolling, keyed, mix, unpacked

SIZE = 64
MOST = 1 << 20
BLOCK = 250_000
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, SIZE, dtype=np.uint64)
EMPTY = np.full(SIZE, 0xFFFFFFFF, np.uint32)


def _parse(text: str, seen: set[str], ends: array, start: int, stop: int) -> int:
    """Parse text[start:stop] with the dictionary ``seen``; phrase ends go to ``ends``. Returns where the open phrase began."""
    add, end = seen.add, ends.append
    phrase = ""
    for k, c in enumerate(text[start:stop], start + 1):
        phrase += c
        if phrase not in seen:
            add(phrase)
            end(k)
            phrase = ""
            if len(seen) == MOST:
                seen.clear()
    return ends[-1] if ends else 0


def phrase_ends(text: str) -> array:
    """Where the phrases of ``text`` end; the last may be one that the dictionary already has."""
    ends = array("q")
    if _parse(text, set(), ends, 0, len(text)) < len(text):
        ends.append(len(text))
    return ends


def parse_pair(text: str, edited: str, head: int) -> tuple[array, array]:
    """``phrase_ends`` of two texts whose first ``head`` code points are the same."""
    seen: set[str] = set()
    ends = array("q")
    at = _parse(text, seen, ends, 0, head)
    if text == edited:
        both = [(text, seen, ends)]
    else:
        both = [(text, seen.copy(), ends[:]), (edited, seen, ends)]
    for t, own_seen, own_ends in both:
        if _parse(t, own_seen, own_ends, at, len(t)) < len(t):
            own_ends.append(len(t))
        own_seen.clear()
    return both[0][2], both[-1][2]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signature(text: str, ends: array) -> np.ndarray:
    """The minima, as 32-bit numbers."""
    if not ends:
        return EMPTY
    end = np.array(ends, np.int64)
    start = np.append(0, end[:-1])
    out = np.full(SIZE, 2**64 - 1, np.uint64)
    a = 0
    while a < len(end):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, "right")))
        x, y = start[a:b] - start[a], end[a:b] - start[a]
        h = mix(Rolling(code_points(text[start[a] : end[b - 1]])).slices(x, y) + (y - x).astype(np.uint64))
        for k in range(0, len(h), 1024):
            np.minimum(out, (h[k : k + 1024, None] * _A + _B).min(axis=0), out=out)
        a = b
    return np.minimum(out >> np.uint64(32), np.uint64(0xFFFFFFFE)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima, 0 to 1."""
    return float(np.mean(a == b))


def to_hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edit(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns and fingerprint (string): no shuffle."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column("_row").field(text_col))
            yield pa.record_batch([batch.column("_row"), pa.array([to_hex(signature(t, phrase_ends(t))) for t in texts], pa.string())], names=["_row", "fingerprint"])

    return unpacked(rows.mapInArrow(run, T.StructType([rows.schema["_row"], T.StructField("fingerprint", T.StringType())])), "fingerprint")


def chain(rows: Iterator[tuple[int, int, bool, str]]) -> Iterator[tuple]:
    """Over (range, id, marked, text) in order, each range ended by a marked row: what ``compare_next`` returns, row by row."""
    before = ready = None  # the row whose successor comes next; the row that waits for its successor's signature
    for part, i, marked, text in rows:
        if before is not None and before[0] == part:
            _, j, own = before
            edited = edit(own, text)
            head = len(own) - len(own) // 2
            ends, edited_ends = parse_pair(own, edited, head)
            sig, edited_sig = signature(own, ends), signature(edited, edited_ends)
            if ready is not None:
                yield *ready[1:], likeness(ready[0], sig)
            ready = (sig, j, len(own), edited, to_hex(sig), to_hex(edited_sig), likeness(sig, edited_sig))
        if not marked:
            before = (part, i, text)
        elif before is not None:
            yield *ready[1:], likeness(ready[0], signature(text, phrase_ends(text)))
            before = ready = None


OUT = pa.schema([("_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("_part", "_id", "_mark")), (x.as_py() for x in b.column("_text")), strict=True))
    held, size = [], 0
    for r in chain(rows):
        held.append(r)
        size += len(r[2])
        if size > 4_000_000 or len(held) == 2000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), OUT, strict=True)], schema=OUT)


def ranges(docs: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Lower bounds (_id, _th) of at most ``parts`` ranges: approximate quantiles of _id, and for an id that is several of them, cuts of the hashes."""
    if parts < 2:
        return []
    got = docs.select(F.percentile_approx("_id", [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first()["q"]
    return sorted((i, -(2**63) + k * 2**64 // n) for i, n in Counter(got or []).items() for k in range(n))


def longs(values: list[int]) -> Column:
    """An array of longs as one literal of the plan, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def position(key: tuple[Column, Column], bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    first, second = (longs([b[k] for b in bounds]) for k in (0, 1))
    steps = longs([1 << b for b in reversed(range(len(bounds).bit_length()))]).cast("array<int>")

    def least(i: Column) -> Column:
        a, b = F.get(first, i), F.get(second, i)
        return (a < key[0]) | ((a == key[0]) & (b <= key[1]))

    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(least(at + s - 1), at + s).otherwise(at))


def _partition_keys(docs: DataFrame, parts: int) -> list[int]:
    """For each of ``parts`` partitions a number that hash partitioning sends there."""
    spark = docs.sparkSession
    tried = spark.range(40 * parts + 200).select("id", F.expr(f"pmod(hash(cast(id as int)), {parts})").alias("p"))
    found = {r["p"]: r["id"] for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, 40 * parts + 200 + p) for p in range(parts)]


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next), one row per row of ``docs``."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = keyed(docs, id_col, text_col)
    key = F.col("_id"), F.col("_th")
    part = position(key, ranges(own.select("_id"), parts))
    firsts = {r["p"]: (r["f"]["_id"], r["f"]["_th"]) for r in own.select(*key, part.alias("p")).groupBy("p").agg(F.min(F.struct(*key)).alias("f")).collect()}  # one a range
    order = sorted(firsts)
    keys = _partition_keys(docs, parts)
    to_key = F.get(longs(keys), part) if len(keys) > 1 else F.lit(0)
    here = F.struct(to_key.cast("int").alias("_part"), F.lit(False).alias("_mark"))
    # a document that begins a range also goes to the end of the range before it, that of the first to the last
    nth = position(key, [firsts[p] for p in order])  # how many ranges begin at or before a document: it is the first of the nth if equal to it
    begins = (F.get(longs([firsts[p][0] for p in order]), nth - 1) == key[0]) & (F.get(longs([firsts[p][1] for p in order]), nth - 1) == key[1])
    there = F.struct(F.get(longs([keys[order[k - 1]] for k in range(len(order))]), nth - 1).cast("int").alias("_part"), F.lit(True).alias("_mark"))
    sent = F.when(begins, F.array(here, there)).otherwise(F.array(here)) if order else F.array(here)
    dealt = own.select(*key, "_text", F.inline(sent)).repartition(parts, "_part").sortWithinPartitions("_part", "_mark", "_id", "_th", "_text")
    return dealt.select("_part", "_id", "_mark", "_text").mapInArrow(_run, "_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
