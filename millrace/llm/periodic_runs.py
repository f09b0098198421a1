"""Periodic run detection (operator 12).

A run is a stretch of neighbouring words with smallest period q (words q apart are the same) of at least max(``LEAST``, ``TIMES`` * q) words that
can't be made longer with period q.

Method: heavy/light lag counting. How often words q apart agree is counted exactly for every lag q up to a third of the text: words
that stand often in a text by autocorrelation of their places (FFT, counts are rounded to whole numbers), rare ones by the differences of pairs of
their places. A run of period q makes at least max(LEAST - q, 2q) neighbouring matches at lag q, so only lags with so many matches get an island scan. The
scan probes every quarter of that length and looks closely only where four probes in a row agree. A stretch that is found at several lags counts once, at the least (the others are its multiples).

Scale: one pass over the documents, no shuffle; texts of a batch are counted together in flat arrays, a very long text alone. Pairs of a rare word are at most
its places times ``_heavy``, about the root of the text's words; memory is some 60 bytes a word of the longest text and the distinct words of it.

Defined cases: null, empty and blank texts have no words and no runs, and the empty text as what is left; words are compared as they are written,
byte for byte; each row is judged alone, so repeated rows and null ids change nothing; the first run of greatest exponent is told by exact fractions, ties
go to the smallest start, then period; an empty table gives an empty result; other columns pass through, one named like an output (n_words, runs, collapsed) is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import flat, pieces, unpacked

LEAST, TIMES = 24, 3
BLOCK_WORDS = 200_000  # counted together
SLICE = 1 << 20  # bytes split at once
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_RUNS_SQL = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _needed(lags: np.ndarray) -> np.ndarray:
    """Neighbouring matches that a run of each lag makes at least."""
    return np.maximum(LEAST - lags, (TIMES - 1) * lags)


def _heavy(n: int) -> int:
    """Words that stand oftener than this in a text of n words are counted by FFT: pairs and transforms then cost about the same."""
    return max(64, int((n * max(1, n.bit_length())) ** 0.5))


def _words(data: memoryview) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number."""
    known: dict[bytes, int] = {}
    codes, a = [], 0
    rest = b""
    while a < len(data):
        part = rest + bytes(data[a : a + SLICE])
        a += SLICE
        own = part.split()  # at the six blanks of ASCII
        if a < len(data) and own and part[-1] not in b" \t\n\x0b\x0c\r":
            rest = own.pop()
        else:
            rest = b""
        codes.append(np.array([known.setdefault(w, len(known)) for w in own], np.int64))
    return (np.concatenate(codes) if codes else np.empty(0, np.int64)), list(known)


def _autocorrelation(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """For lags 0 to ``most``, how many places of the same word lie that far apart; places of each frequent word in a text of n words."""
    size = 1 << (n + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for own in places:
        there = np.zeros(size)
        there[own] = 1
        f = np.fft.rfft(there)
        power += f.real**2 + f.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_counts(codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often words of a text agree at each lag, for texts end to end (codes of different texts differ): the counts of lags 1 to a third of each text's
    words, end to end, and their n + 1 offsets."""
    n = np.diff(offs)
    most = n // TIMES
    base = np.append(0, np.cumsum(most))
    counts = np.zeros(int(base[-1]), np.int64)
    if not len(counts):
        return counts, base
    order = np.argsort(codes, kind="stable")
    key = codes[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    often = np.diff(np.append(begins, len(key)))
    text = np.searchsorted(offs, order, "right") - 1
    limit = np.array([_heavy(x) for x in n.tolist()])
    heavy = often > limit[text[begins]]
    for t in np.unique(text[begins[heavy]]).tolist():
        own = [order[a : a + k] - offs[t] for a, k in zip(begins[heavy].tolist(), often[heavy].tolist(), strict=True) if text[a] == t]
        counts[base[t] : base[t + 1]] += _autocorrelation(own, int(n[t]), int(most[t]))[1:]
    # pairs of places of the rest, j places apart in the list of a word's places
    left = np.flatnonzero(~np.repeat(heavy, often))
    room = most[text]
    j = 1
    while True:
        left = left[left + j < len(key)]
        left = left[key[left + j] == key[left]]
        gap = order[left + j] - order[left]
        near = gap <= room[left]
        left = left[near]  # places ascend, so the next pair of a place lies farther apart
        if not len(left):
            return counts, base
        at = base[text[left]] + gap[near] - 1
        if len(at) * 16 > len(counts):
            counts += np.bincount(at, minlength=len(counts))
        else:
            np.add.at(counts, at, 1)
        j += 1


def _islands(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Start and end of stretches of at least ``least`` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    a, b = edges[::2], edges[1::2]
    ok = b - a >= least
    return list(zip(a[ok].tolist(), b[ok].tolist(), strict=True))


def _scan(x: np.ndarray, lag: int, known: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """(start, length) of every stretch of x that agrees at ``lag`` and is long enough for a run.

    known: runs of smaller periods. Probes that lie inside one whose period divides the lag need no look: a stretch that holds it whole
    would have its period all over, so it is the same stretch."""
    least = max(LEAST - lag, (TIMES - 1) * lag)
    n = len(x) - lag
    step = least // 4
    if step < 8 or n < 4096:
        return [(a, b - a + lag) for a, b in _islands(x[:n] == x[lag:], least)]
    probe = np.arange(0, n, step)  # four in a row at least lie in a stretch of ``least``
    found: list[tuple[int, int]] = []
    inside = [(s, s + length) for (s, length), period in known.items() if lag % period == 0]
    for a, b in _islands(x[probe] == x[probe + lag], least // step):
        if any(s <= probe[a] and probe[b - 1] + lag < e for s, e in inside):
            continue
        lo, hi = max(0, int(probe[a]) - step + 1), min(n, int(probe[b - 1]) + step)
        found += [(lo + s, e - s + lag) for s, e in _islands(x[lo:hi] == x[lo + lag : hi + lag], least)]
    return found


def runs_of(codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of a text's runs by start, then period; counts: how often its words agree at lags 1, 2, ..."""
    lags = np.flatnonzero(counts >= _needed(np.arange(1, len(counts) + 1))) + 1
    found: dict[tuple[int, int], int] = {}
    for lag in lags.tolist():  # ascending: a stretch keeps its smallest period
        for where in _scan(codes, lag, found):
            found.setdefault(where, lag)
    return sorted((start, length, period) for (start, length), period in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are left when every run keeps its first period only."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] == 0


def most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equals the one of smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _texts(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[bytes], list[tuple[int, int, int]]]]:
    """(number, words as numbers, words by number, runs) of each text."""
    view = memoryview(np.ascontiguousarray(data))
    n = len(offs) - 1
    i = 0
    while i < n:
        held, total = [], 0
        while i + len(held) < n and total < BLOCK_WORDS:
            k = i + len(held)
            held.append(_words(view[int(offs[k]) : int(offs[k + 1])]))
            total += len(held[-1][0])
        base = np.append(0, np.cumsum([len(known) for _, known in held]))
        flat_codes = np.concatenate([codes + b for (codes, _), b in zip(held, base, strict=False)])
        bounds = np.append(0, np.cumsum([len(codes) for codes, _ in held]))
        counts, at = lag_counts(flat_codes, bounds)
        for k, (codes, known) in enumerate(held):
            own = counts[at[k] : at[k + 1]]
            yield i + k, codes, known, runs_of(codes, own) if len(codes) >= LEAST else []
        i += len(held)


def _joined(codes: np.ndarray, known: list[bytes]) -> bytes:
    return b" ".join([known[c] for c in codes.tolist()])


def _digest(codes: np.ndarray, known: list[bytes]) -> str:
    """SHA-256 of the words joined by one space, without the joined text."""
    h = hashlib.sha256()
    for a in range(0, len(codes), BLOCK_WORDS):
        h.update((b" " if a else b"") + _joined(codes[a : a + BLOCK_WORDS], known))
    return h.hexdigest()


def _find(text_column: str, collapsed: bool, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, runs, left = [], [], []
            for _, codes, known, found in _texts(*flat(batch.column(text_column))):
                n.append(len(codes))
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in found])
                kept = codes[kept_words(len(codes), found)] if found else codes
                left.append(_joined(kept, known).decode() if collapsed else _digest(kept, known))
            yield pa.record_batch([*(batch.column(c) for c in carried), pa.array(n, pa.int64()), pa.array(runs, _RUNS), pa.array(left, pa.string())], names=[*carried, "n_words", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with all columns and n_words (long), runs (start, length, period by start, then period) and collapsed (text: of each run the first period, words joined by one space)."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = T.StructType([own.schema["_row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(_RUNS_SQL)), T.StructField("collapsed", T.StringType())])
    return unpacked(own.mapInArrow(_find("_text", True, ["_row"]), out), "n_words", "runs", "collapsed")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, runs, collapsed_sha256): as ``find_runs``, but for the id and the SHA-256 of the collapsed text, so that no text leaves its task."""
    own = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = T.StructType([own.schema["_key"], T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(_RUNS_SQL)), T.StructField("collapsed", T.StringType())])
    return own.mapInArrow(_find("_text", False, ["_key"]), out).select(F.col("_key").alias(id_col), "n_words", "runs", F.col("collapsed").alias("collapsed_sha256"))
