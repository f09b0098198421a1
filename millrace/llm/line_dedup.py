"""Line dedup across documents (operator 2).

Method: every line's key is hashed to 128 bits; (key, document, line numbers) rows are range-partitioned by key and
document and sorted within partitions, largest document first; each partition is streamed once, the first document of a
key keeps its lines, the others lose them once the key has been seen in ``min_docs`` documents. What comes back is a
compressed keep-bitmap per document, never text.

Scale. The range partitioner splits by (key, document), so a key that a third of all documents hold spreads over many
partitions. A partition can decide alone all keys but the first, which may have begun before it, and the last, which may go
on; for these two it emits the rows undecided and one summary each. Summaries (at most two a partition) are broadcast:
their number is bounded by the number of partitions. At most ``min_docs - 1`` documents of one key are held in memory.

Defined cases: null or empty text is one empty line; keys under ``min_chars`` code points never count; a line
repeated within one document counts once, and all its occurrences share the verdict; rows with the same id count as one
document; null ids count as one document, smaller than all others; documents can't tie, as the largest id keeps the lines; a very long text is held whole where its lines are
split and where they are put together again; an empty table gives an empty result; other columns of ``dedup_lines`` pass through, one named like an output (n_lines, n_dropped, kept_text) is
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import keyed, packed, pieces, unpacked, written

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}
_ROWS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("n_lines", pa.int32()), ("lines", pa.list_(pa.int32()))])
_FOUND = pa.schema([*_ROWS, ("state", pa.int32()), ("docs", pa.int64()), ("top", pa.int64())])
DROP, OPEN, SUMMARY = 0, 1, 2


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(LOWER)


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            cols: list[list] = [[] for _ in _ROWS]
            for i, th, text in zip(*(batch.column(k).to_pylist() for k in ("_id", "_th", "_text")), strict=True):
                lines = text.split("\n")
                at: dict[str, list[int]] = {}
                for n, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        at.setdefault(key, []).append(n)
                for key, where in at.items():
                    h = xxhash.xxh3_128_intdigest(key.encode())
                    for c, v in zip(cols, ((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, i, th, len(lines), where), strict=True):
                        c.append(v)
                if len(cols[0]) >= 10_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)
                    cols = [[] for _ in _ROWS]
            if cols[0]:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ROWS, strict=True)], schema=_ROWS)

    return run


def _stream(min_docs: int):
    """Over one sorted partition. Yields rows to drop, rows left open (first and last key) and summaries of those keys."""

    def tagged(batch: pa.RecordBatch, state: int) -> pa.RecordBatch:
        n = batch.num_rows
        return pa.record_batch([*batch.columns, pa.array(np.full(n, state, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_FOUND)

    def summary(key: tuple[int, int], docs: int, top: int) -> pa.RecordBatch:
        return pa.record_batch([pa.array([v], f.type) for v, f in zip((*key, None, None, None, None, SUMMARY, docs, top), _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, docs, top, last = None, True, 0, 0, 0  # of the key being read
        held: list[pa.RecordBatch] = []  # its rows so far, while fewer than min_docs documents have it

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k1, k2, ids = (batch.column(k).to_numpy() for k in ("k1", "k2", "_id"))
            new_key = np.empty(n, bool)
            new_key[0] = key != (int(k1[0]), int(k2[0]))
            new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = new_key.copy()
            new_doc[0] |= int(ids[0]) != last
            new_doc[1:] |= ids[1:] != ids[:-1]
            starts = np.flatnonzero(new_key)
            bounds = [0, *starts[starts > 0].tolist(), n] if n else [0]
            drop = np.zeros(n, bool)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if new_key[a]:
                    if key is not None:
                        if first:
                            yield summary(key, docs, top)
                        first = False
                    first = key is None
                    key, docs, top, held = (int(k1[a]), int(k2[a])), 0, int(ids[a]), []
                before = docs
                docs += int(new_doc[a:b].sum())
                last = int(ids[b - 1])
                if first:
                    yield tagged(batch.slice(a, b - a), OPEN)
                elif docs >= min_docs:
                    if before < min_docs:
                        for part in held:
                            mask = part.column("_id").to_numpy() != top
                            if mask.any():
                                yield tagged(part.filter(pa.array(mask)), DROP)
                        held = []
                    drop[a:b] = ids[a:b] != top
                elif b == n:
                    held.append(batch.slice(a, b - a))
            if drop.any():
                yield tagged(batch.filter(pa.array(drop)), DROP)
        if key is not None:
            for part in held:
                yield tagged(part, OPEN)
            yield summary(key, docs, top)

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[gone] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.record_batch([batch.column("_id"), batch.column("_th"), batch.column("n_lines"), pa.array(out, pa.binary())], names=["_id", "_th", "n_lines", "keep"])


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """A keep-bitmap as booleans, one a line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(_id, _th, n_lines, keep): the compressed keep-bitmap of every document that loses a line."""
    rows = written(keyed(docs, id_col, text_col).mapInArrow(_keys(min_chars), "k1 long, k2 long, _id long, _th long, n_lines int, lines array<int>"), "lines")
    order = [F.col("k1"), F.col("k2"), F.col("_id").desc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        _stream(min_docs), "k1 long, k2 long, _id long, _th long, n_lines int, lines array<int>, state int, docs long, top long"
    )
    found = written(found, "line-verdicts")
    whole = found.where(F.col("state") == SUMMARY).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))
    cols = ["_id", "_th", "n_lines", "lines"]
    late = found.where(F.col("state") == OPEN).drop("docs", "top").join(F.broadcast(whole), ["k1", "k2"]).where((F.col("docs") >= min_docs) & (F.col("_id") != F.col("top")))
    gone = found.where(F.col("state") == DROP).select(cols).unionByName(late.select(cols))
    per_doc = gone.groupBy("_id", "_th", "n_lines").agg(F.flatten(F.collect_list("lines")).alias("gone"))
    return per_doc.mapInArrow(_bitmaps, "_id long, _th long, n_lines int, keep binary")


def _apply(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows, kept, total, dropped = batch.column("_row"), [], [], []
            for text, keep in zip(rows.field(text_col).to_pylist(), batch.column("keep").to_pylist(), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                lost = 0
                if keep is not None:
                    mask = unpack(keep, n)
                    lost = n - int(mask.sum())
                    text = "\n".join(line for line, k in zip(text.split("\n"), mask.tolist(), strict=True) if k)
                kept.append(text)
                total.append(n)
                dropped.append(lost)
            yield pa.record_batch([rows, pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["_row", "n_lines", "n_dropped", "kept_text"])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with all columns and n_lines, n_dropped (long) and kept_text (the lines left, joined by a newline)."""
    bitmaps = line_bitmaps(docs, id_col, text_col, min_chars, min_docs).drop("n_lines")
    whole = packed(docs, id_col, text_col).join(bitmaps, ["_id", "_th"], "left").select("_row", "keep")
    out = T.StructType([whole.schema["_row"], *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")), T.StructField("kept_text", T.StringType())])
    return unpacked(whole.mapInArrow(_apply(text_col), out), "n_lines", "n_dropped", "kept_text")
