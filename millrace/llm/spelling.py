"""Spelling variant grouping (operator 13).

Method: two words one edit apart agree up to the edit and behind it, so one of the edit's sides is at least half of the word. The dictionary is sorted twice, by the
words and by the reversed words: words that share their first half make a block in the one, words that share their last half in the other, and a range scan over the
sorted blocks verifies the pairs in them. A block of more than ``BLOCK`` words is subdivided: what lies between the known prefix and the known suffix is halved in the same way, until blocks
are small or one character is left (such a block has at most as many words as there are letters, and their insertions). Blocks are made for each length c, of words of c and of c + 1 characters.
A pair is told in one block only: a block behind a suffix step takes pairs that differ before that step's half, all others belong to the block of the prefix step.

Scale. Words are counted in the tasks before the shuffle. Four rows a word go into blocks; sizes of blocks are counted with partial sums, only the
oversized ones are joined back, and each level at least halves what is unknown of a word. A task streams sorted blocks; what leaves it is one row a word and
block (neighbours, best neighbour), never a pair. Chains of forms are followed by pointer doubling; as a form is at least ``TIMES`` times as frequent as the word, a chain is short and
the number of doublings follows from the largest count.

Defined cases: null or empty texts have no words; null ids count as the empty text (ids matter only to ``damage``); rows are counted as often as they come; of equally frequent
neighbours the first by code points is the form; words of any length (runs of letters across a block of text are kept whole), a text is read in blocks; an empty table gives an empty result; columns other than the id and
the text aren't used, as the result is a table of words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import pieces, written

LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
BLOCK = 128  # words that are compared with one another
PAIR_CHARS = 4_000_000  # characters of pairs compared at once
FLUSH = 200_000  # words a task counts before it hands them on
SLICE = 1 << 20  # characters read at once
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_GAP = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, a block of text at a time."""
    a = 0
    while a < len(text):
        b = len(text)
        if b - a > SLICE:
            gap = _GAP.search(text, a + SLICE)
            b = gap.start() if gap else b
        yield _RUN.findall(text, a, b)
        a = b


def _count(least_chars: int, damage: int):
    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in pieces(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                begun = zlib.crc32(f"{key}:".encode())
                for found in _runs(text):
                    for word, n in Counter(found).items():
                        low = word if word.islower() else word.translate(_LOWER)
                        if damage and not (h := zlib.crc32(low.encode(), begun)) % damage:
                            k = h % len(low)
                            low = low[:k] + low[k + 1 :]
                        if len(low) >= least_chars:
                            counts[low] += n
                if len(counts) >= FLUSH:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, damage: int = 0) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at least ``least_chars`` characters that occur ``least_count`` times or more.

    damage: for tests and trials, every run whose crc32 of ``<id>:<run>`` is a multiple of it loses the character at that crc32 modulo the run's length; 0 for none."""
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(_count(least_chars, damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _block(c: Column, lo: Column, hi: Column, cap: Column) -> list[Column]:
    """A block: words of c or c + 1 characters with ``lo`` first and ``hi`` last characters in common; it takes pairs that differ before character ``cap``."""
    last = F.when(hi > 0, F.reverse(F.expr("right(word, hi)"))).otherwise("")
    key = F.concat_ws("\x01", c.cast("string"), lo.cast("string"), hi.cast("string"), cap.cast("string"), F.substring("word", 1, lo), last)
    return [c.alias("c"), lo.alias("lo"), hi.alias("hi"), cap.alias("cap"), key.alias("key")]


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in its block's two children: the first half of what is unknown shared, or the second."""
    half = F.floor((F.col("c") - F.col("lo") - F.col("hi")) / 2).cast("int")
    rest = F.col("c") - F.col("lo") - F.col("hi") - half
    step = lambda lo, hi, cap: F.struct(lo.alias("lo"), hi.alias("hi"), cap.alias("cap"))
    both = F.array(step(F.col("lo") + half, F.col("hi"), F.col("cap")), step(F.col("lo"), F.col("hi") + rest, F.col("lo") + half))
    deeper = rows.select("word", "n", "size", "c", F.explode(both).alias("to")).select("word", "n", "size", "c", "to.*")
    return deeper.select("word", "n", "size", *_block(F.col("c"), F.col("lo"), F.col("hi"), F.col("cap")))


def blocks(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(key, c, cap, size, word, n): every word in the blocks that its neighbours can be found in."""
    size = F.char_length("word")
    begun = words.select("word", "n", size.alias("size"), F.explode(F.array(size, size - 1)).alias("c")).where(F.col("c") >= least_chars)
    todo = written(_halved(begun.withColumns({"lo": F.lit(0), "hi": F.lit(0), "cap": F.col("c") + 2})), "blocks")
    small = []
    while True:
        large = written(todo.where(F.col("c") - F.col("lo") - F.col("hi") > 1).groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > block), "large-blocks")
        if large.isEmpty():
            small.append(todo)
            break
        dealt = written(todo.join(large, "key", "left"), "dealt-blocks")
        small.append(dealt.where(F.col("words").isNull()).drop("words"))
        todo = written(_halved(dealt.where(F.col("words").isNotNull())), "blocks")
    out = small[0]
    for more in small[1:]:
        out = out.unionByName(more)
    return out.select("key", "c", "cap", "size", "word", "n")


def _pairs(ends: np.ndarray, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs (a shorter or equally long word first) within blocks; ``ends`` is the end of each row's block, ``short`` tells its shorter words, which come first."""
    first = np.flatnonzero(short)
    partners = ends[first] - first - 1
    first, partners = first[partners > 0], partners[partners > 0]
    a = np.repeat(first, partners)
    begun = np.repeat(np.cumsum(partners) - partners, partners)
    return a, a + 1 + np.arange(len(a)) - begun


def _near(chars: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, c: int, cap: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart, the first difference before ``cap``; chars: one row a word, padded with zeros to c + 1."""
    x, y = chars[a], chars[b]
    unlike = x != y
    at = unlike.argmax(1)
    replaced = (size[b] == c) & (unlike.sum(1) == 1)
    back = (x[:, :c] != y[:, 1 : c + 1])[:, ::-1]
    behind = np.where(back.any(1), back.argmax(1), c)  # characters the two agree in from their ends
    inserted = (size[b] == c + 1) & (at + behind >= c)
    return (replaced | inserted) & (at < cap)


def _told(rows: pa.Table) -> pa.RecordBatch:
    """(word, n_near, best_n, best): of the words of whole blocks, sorted by block and length, those that have a neighbour there."""
    key = rows.column("key").combine_chunks()
    n_rows = len(key)
    new = np.append(True, np.asarray(pc.not_equal(key[1:], key[:-1]))) if n_rows > 1 else np.ones(n_rows, bool)
    begins = np.flatnonzero(new)
    ends = np.repeat(np.append(begins[1:], n_rows), np.diff(np.append(begins, n_rows)))
    c_of, size, cap, n = (rows.column(k).to_numpy() for k in ("c", "size", "cap", "n"))
    words = np.array(rows.column("word").to_pylist(), object)
    near = np.zeros(n_rows, np.int64)
    best = np.full(n_rows, -1, np.int64)  # row of the best neighbour

    def better(of: np.ndarray, other: np.ndarray) -> None:
        for i, j in zip(of.tolist(), other.tolist(), strict=True):
            k = best[i]
            if k < 0 or (n[j], words[k]) > (n[k], words[j]):
                best[i] = j

    for c in np.unique(c_of).tolist():
        own = np.flatnonzero(c_of == c)  # rows of a block are together, and stay so
        a, b = _pairs(np.searchsorted(own, ends[own]), size[own] == c)
        if not len(a):
            continue
        used = np.unique(np.concatenate([a, b]))
        chars = np.array(words[own[used]].tolist(), f"U{c + 1}").view(np.uint32).reshape(len(used), c + 1)
        a, b = np.searchsorted(used, a), np.searchsorted(used, b)
        own = own[used]
        step = max(1, PAIR_CHARS // (c + 1))
        for k in range(0, len(a), step):
            i, j = a[k : k + step], b[k : k + step]
            ok = _near(chars, size[own], i, j, c, cap[own[i]])
            i, j = own[i[ok]], own[j[ok]]
            near += np.bincount(i, minlength=n_rows) + np.bincount(j, minlength=n_rows)
            better(i, j)
            better(j, i)
    some = np.flatnonzero(near)
    return pa.record_batch([pa.array(words[some], pa.string()), pa.array(near[some]), pa.array(n[best[some]], pa.int64()), pa.array(words[best[some]], pa.string())], names=["word", "n_near", "best_n", "best"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted partition: blocks are told once they are whole; the last one of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key")
        last = key[-1]
        inside = np.asarray(pc.equal(key, last))
        a = int(inside.argmax())  # where the last block begins in this batch
        if a == 0 and held and held[-1].column("key")[-1] == last:
            held.append(batch)
            continue
        whole = pa.Table.from_batches([*held, batch.slice(0, a)])
        if whole.num_rows:
            yield _told(whole)
        held = [batch.slice(a)]
    if held:
        yield _told(pa.Table.from_batches(held))


def neighbours(words: DataFrame, least_chars: int = LEAST_CHARS, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have a word one edit away: how many, and the most frequent of them."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks(words, least_chars, block).repartitionByRange(parts, "key").sortWithinPartitions("key", "size", "word").mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    most = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), most.alias("most")).select("word", "n_near", (-F.col("most.n")).alias("best_n"), F.col("most.best").alias("best"))


def group(words: DataFrame, least_chars: int = LEAST_CHARS, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table of distinct words and their counts (word, n)."""
    words = written(words.select("word", "n"), "words")
    near = neighbours(words, least_chars, block)
    rows = words.join(near, "word", "left").withColumn("takes", F.coalesce(F.col("best_n") >= times * F.col("n"), F.lit(False)))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("takes"), F.col("best")).alias("form"), F.when(F.col("takes"), F.col("best_n")).alias("form_n")), "forms")
    roots = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    span = roots.join(words, "word").agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    if span["most"]:
        steps = math.floor(math.log(span["most"] / span["least"], times) + 1e-9) + 1  # words of one chain that have a form, at most
        for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
            onward = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
            roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, damage: int = 0) -> DataFrame:
    """Words of ``docs`` and their forms: (word, form, root, n, n_near, form_n). A word's form is its most frequent neighbour one edit away, if that is ``times`` as frequent; its root is where the forms end."""
    return group(vocabulary(docs, id_col, text_col, least_chars, least_count, damage), least_chars, times)
