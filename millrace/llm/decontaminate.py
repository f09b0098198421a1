"""Benchmark decontamination by winnowing (operator 11).

Method: words are hashed, every ``GRAM`` neighbouring words make a gram, and the least gram hash of each window of ``WINDOW`` words is
its fingerprint. Neighbouring windows mostly share their fingerprint, so a text is told by about two grams in seven; and as a window of the
benchmark and an equal one of a document have the same least gram, no shared span of ``WINDOW`` words or more is missed. Fingerprints of both
sides are joined, and a hit is extended to its whole window, which has to be the same text: hashes nominate, words decide.
Items of fewer words are one window of that many words; documents are fingerprinted for each length that the benchmark has (ten at most).

Scale. Documents are read once. A Bloom filter of at most 8 MB over the benchmark's fingerprints keeps nearly all other windows of the documents in
their task. Each distinct window of the benchmark is one row, so the join gives one row a matching window of a document, also for a
passage that a third of all documents hold; its plain equality of two shuffled sides lets adaptive execution split such a key. Items come by classes of windows that
the same items hold, so a window of many items isn't multiplied by its documents' windows.

Defined cases: null or empty text (of either side) has no words and no windows; an item without words hits nothing; null item ids count as the empty
text, rows with one item id as one item; rows with one document id and one text are the same document twice and get one answer
each, rows with one id and different texts are judged apart; equal windows of several items count for all of them, so there are no ties; very long texts are worked on in
blocks of about ``BLOCK`` bytes that share nine words; an empty benchmark leaves every document clean, and empty documents give an empty result; other columns of
``decontaminate`` pass through, one named like an output (n_words, n_hit, spans, items) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_CODES, Rolling, Sieve, flat, keyed, mix, packed, pieces, unpacked, written
from .shingles import word_spans

WINDOW, GRAM = 10, 5
BLOCK = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = BYTE_CODES[_LOWER]
#: Letters and digits of ASCII, and all bytes of other characters.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WEIGHTS = mix(np.arange(1, GRAM + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
_SALT = np.uint64(0x27D4EB2F165667C5)
_OWN = "_id long, _th long, n_words long, fp long, other long, window string, at long, size int"


def fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """The least gram hash of every window of ``size`` words (hashes of words); grams have ``GRAM`` words, in smaller windows as many as there are."""
    k = min(GRAM, size)
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    m = len(words) - k + 1
    grams = mix(sum((words[i : m + i] * _WEIGHTS[i] for i in range(k)), np.full(m, k, np.uint64)))
    least = grams[:n].copy()
    for i in range(1, size - k + 1):
        np.minimum(least, grams[i : n + i], out=least)
    return least


def _other(prints: np.ndarray) -> np.ndarray:
    """A second hash of fingerprints, for the filter."""
    return mix(prints ^ _SALT).view(np.int64)


def _passing(prints: np.ndarray, sieve: Sieve | None) -> np.ndarray:
    """Which windows' fingerprints pass; equal neighbours are looked up once."""
    if sieve is None or not len(prints):
        return np.ones(len(prints), bool)
    begins = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    own = prints[begins]
    return np.repeat(sieve.passes(own.view(np.int64), _other(own)), np.diff(np.append(begins, len(prints))))


def _cut(data: np.ndarray, size: int) -> int:
    """Where a block of about ``size`` bytes may end: behind a byte that stands in no word, or at the end."""
    if len(data) <= size:
        return len(data)
    gaps = np.flatnonzero(~_LETTERS[data[size // 2 : size]])
    if len(gaps):
        return size // 2 + int(gaps[-1]) + 1
    for a in range(size, len(data), size):
        gaps = np.flatnonzero(~_LETTERS[data[a : a + size]])
        if len(gaps):
            return a + int(gaps[0]) + 1
    return len(data)


def _blocks(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple]:
    """(first text, word number at the block's start, new words of each text, bytes, starts, ends, first word of each text) of blocks of whole texts, or of parts of
    one long text; a part begins with the last ``WINDOW - 1`` words of the part before."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK, "right")) - 1)
        a, b = int(offs[i]), int(offs[j])
        if b - a <= BLOCK:
            own, bounds = data[a:b], offs[i : j + 1] - a
            start, end = word_spans(own, bounds, _LETTERS) if b > a else (np.empty(0, np.int64),) * 2
            at = np.searchsorted(start, bounds)
            yield i, 0, np.diff(at), own, start, end, at
        else:
            done, old, size = 0, 0, BLOCK  # words before the block, words it shares with the one before
            while True:
                own = data[a : a + _cut(data[a:b], size)]
                start, end = word_spans(own, np.array([0, len(own)]), _LETTERS)
                last = a + len(own) == b
                if not last and len(start) < 2 * WINDOW:  # words longer than blocks
                    size *= 2
                    continue
                yield i, done, np.array([len(start) - old]), own, start, end, np.array([0, len(start)])
                if last:
                    break
                old = WINDOW - 1
                done += len(start) - old
                a, size = a + int(start[len(start) - old]), BLOCK
        i = j


def _windows(data: np.ndarray, offs: np.ndarray, sizes: list[int], sieve: Sieve | None, whole: bool) -> Iterator[tuple]:
    """(first text, new words of each text, rows) of each block, rows being (text, word number, size, fingerprint, second hash, window's words).
    whole: of an item, whose windows have ``WINDOW`` words or, if there are fewer, all of them."""
    for i, done, new, own, start, end, at in _blocks(data, offs):
        rows: list[tuple] = []
        if len(start):
            words = mix(Rolling(own, _CODES).slices(start, end) + (end - start).astype(np.uint64))
            text = np.repeat(np.arange(len(at) - 1), np.diff(at))
            length = np.diff(at)[text]
            low = _LOWER[own]
            for size in sizes:
                prints = fingerprints(words, size)
                n = len(prints)
                ok = text[:n] == text[size - 1 :]
                ok &= (np.minimum(length[:n], WINDOW) == size) if whole else _passing(prints, sieve)
                found = np.flatnonzero(ok)
                if not len(found):
                    continue
                own_prints = prints[found]
                starts, ends = start.tolist(), end.tolist()
                for s, fp, other in zip(found.tolist(), own_prints.view(np.int64).tolist(), _other(own_prints).tolist(), strict=True):
                    window = b" ".join(low[x:y].tobytes() for x, y in zip(starts[s : s + size], ends[s : s + size], strict=True))
                    t = int(text[s])
                    rows.append((t, s - int(at[t]) + done, size, fp, other, window.decode()))
        yield i, new, rows


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(fp, other, window, size, items): the distinct windows of the benchmark, with their items' ids as texts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names = batch.column("item").to_pylist()
            for i, _, rows in _windows(*flat(batch.column("text")), list(range(1, WINDOW + 1)), None, True):
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.record_batch(
                    [pa.array([names[i + t] for t in cols[0]], pa.string()), *(pa.array(cols[k], kind) for k, kind in ((3, pa.int64()), (4, pa.int64()), (5, pa.string()), (2, pa.int32())))],
                    names=["item", "fp", "other", "window", "size"],
                )

    own = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = own.mapInArrow(run, "item string, fp long, other long, window string, size int")
    return rows.groupBy("fp", "other", "window", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(sizes: list[int], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
            total = np.zeros(batch.num_rows, np.int64)
            for i, new, rows in _windows(*flat(batch.column("_text")), sizes, shared.value, False):
                total[i : i + len(new)] += new
                if rows:
                    t, at, size, fp, other, window = zip(*rows, strict=True)
                    t = np.array(t) + i
                    nothing = pa.nulls(len(t), pa.int64())
                    yield pa.record_batch([pa.array(ids[t]), pa.array(ths[t]), nothing, pa.array(fp, pa.int64()), pa.array(other, pa.int64()), pa.array(window, pa.string()), pa.array(at, pa.int64()), pa.array(size, pa.int32())], names=_NAMES)
            n = len(total)
            yield pa.record_batch([pa.array(ids), pa.array(ths), pa.array(total), *(pa.nulls(n, kind) for kind in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32()))], names=_NAMES)

    return run


_NAMES = [x.split()[0] for x in _OWN.split(", ")]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each document to spans of words [start, stop) that touch no other, and their words counted."""
    for batch in batches:
        spans, counts = [], []
        for found in batch.column("windows").to_pylist():
            at = np.array([x["at"] for x in found])
            order = np.argsort(at)
            at = at[order]
            stop = np.maximum.accumulate((at + np.array([x["size"] for x in found])[order]))
            first = np.append(True, at[1:] > stop[:-1])
            a, b = at[first], stop[np.append(np.flatnonzero(first)[1:] - 1, len(at) - 1)]
            counts.append(int((b - a).sum()))
            spans.append([{"start": x, "stop": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.record_batch([batch.column("_id"), batch.column("_th"), batch.column("classes"), pa.array(counts, pa.int64()), pa.array(spans, kind)], names=["_id", "_th", "classes", "n_hit", "spans"])


def overlaps(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(_id, _th, n_words, n_hit, spans, items) of every row: words, words inside an item's window, where, and the items whose windows occur."""
    spark = docs.sparkSession
    windows = written(item_windows(bench, item_col, item_text_col).withColumn("class", F.md5(F.to_json("items"))), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW values at most
    sieve = Sieve(windows.select("fp", "other").distinct(), (F.col("fp"), F.col("other")))
    own = written(keyed(docs, id_col, text_col).mapInArrow(_scan(sizes, spark.sparkContext.broadcast(sieve)), _OWN), "document-windows")
    hits = own.where(F.col("fp").isNotNull()).select("_id", "_th", "fp", "window", "at", "size").join(windows.select("fp", "window", "class"), ["fp", "window"])
    found = hits.groupBy("_id", "_th").agg(F.collect_set(F.struct("at", "size")).alias("windows"), F.collect_set("class").alias("classes"))
    found = written(found.mapInArrow(_merge, "_id long, _th long, classes array<string>, n_hit long, spans array<struct<start:long,stop:long>>"), "overlaps")
    classes = windows.select("class", "items").dropDuplicates(["class"])
    items = found.select("_id", "_th", F.explode("classes").alias("class")).join(classes, "class").groupBy("_id", "_th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    per_doc = found.drop("classes").join(items, ["_id", "_th"])
    every = own.where(F.col("fp").isNull()).select("_id", "_th", "n_words").join(per_doc, ["_id", "_th"], "left")
    return every.select(
        "_id", "_th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,stop:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with all columns and n_words, n_hit (long), spans (word numbers) and items (ids as texts); n_hit > 0 marks the contaminated."""
    found = overlaps(docs, bench, id_col, text_col, item_col, item_text_col).dropDuplicates(["_id", "_th"])
    return unpacked(packed(docs, id_col, text_col).join(found, ["_id", "_th"]), "n_words", "n_hit", "spans", "items")
