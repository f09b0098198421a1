"""Suffix-array dedup of repeated byte strings (operator 1).

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else (any document, same one included) is
removed; strings are judged on the input as it is.

Method: difference-cover suffix sorting (``suffixes``: sampled triples are sorted and named, names are sorted recursively,
the remaining suffixes are merged), then the bytes of adjacent suffixes are compared: those that agree on ``LENGTH`` bytes are repeats. To distribute
it, suffixes that can have a partner are brought together first, and only they:

1. Each window of LENGTH bytes picks an anchor from its own bytes: the KGRAM-byte string of least hash, leftmost on ties. Equal
   windows pick equal anchors at the same place. Windows with the same anchor are a run, kept as (anchor name, place): one row
   for about 85 bytes of text.
2. Anchor names that occur once end here: no window of theirs has a partner. The other runs are fetched as bytes ("contexts").
3. Contexts of one name that are equal byte for byte are grouped by Spark: all their windows repeat, and one of them goes on.
4. The different contexts of many names are laid end to end, in portions of at most ``PORTION`` bytes, and suffix-sorted.
5. A name whose contexts outgrow a portion (the ends of a passage that very many documents share) is refined: by the place of the anchor within a
   window, its windows fall into two halves; all windows of a half hold more of the bytes around the anchor, and that longer string names
   the half. Halves go through steps 3 and 4, again refined if need be; after eight rounds at most a half is a single window, whose
   name is all its bytes. So no name is too hot, whatever its size, and every name ends in steps 3 and 4.
6. Runs of repeated windows become byte ranges; they are gathered by document and cut out of the text.

Hashes only bring strings together; what is removed has been compared byte by byte.

Scale. Names are counted by aggregation before the shuffle, the join back is split by adaptive execution where a name is
hot, equal contexts are combined before the shuffle, and nothing is broadcast or collected but a Bloom filter of at most 8 MB, which keeps texts without repeats
out of the shuffles. A text longer than ``BLOCK`` bytes is scanned in overlapping blocks; it is held whole, and its contexts with it, where it is cut. Texts cross the shuffle compressed.

Defined cases: null and empty texts have no bytes and none removed; rows that repeat (same id and text) are
different places, so they remove each other; null ids are ids like others; texts under LENGTH bytes stay whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_CODES, Rolling, Sieve, flat, keyed, mix, passing, sieved, unzip, written
from .suffixes import suffix_order

LENGTH, KGRAM = 200, 32
WIDTH = LENGTH - KGRAM + 1  # places of an anchor within a window
BLOCK = 250_000
PORTION = 400_000
AT = np.uint64((1 << 24) - 1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours: running minima from both ends of blocks."""
    n = len(h)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (text, start of the first window, windows, anchor name, anchor's place in the first window) of each run."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none
    rolling = Rolling(data, BYTE_CODES)
    h = mix(rolling.windows(KGRAM))
    place = (_least((h & ~AT) | np.arange(len(h), dtype=np.uint64), WIDTH) & AT).astype(np.int64)
    last = np.full(len(place), False)  # windows that cross the end of a text
    ends = offs[1:-1]
    cross = np.zeros(len(place) + 1, np.int32)
    np.add.at(cross, np.maximum(ends - LENGTH + 1, 0).clip(max=len(place)), 1)
    np.add.at(cross, ends.clip(max=len(place)), -1)
    last = np.cumsum(cross[:-1]) > 0
    fresh = np.empty(len(place), bool)
    fresh[0] = True
    fresh[1:] = (place[1:] != place[:-1]) | (last[1:] != last[:-1])
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(place)))
    ok = ~last[start]
    start, count = start[ok], count[ok]
    at = place[start]
    text = np.searchsorted(offs, start, "right") - 1
    return text, start - offs[text], count, h[at].view(np.int64), at - start


_RUNS = pa.schema([("name", pa.int64()), ("_id", pa.int64()), ("_th", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("o", pa.int32())])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = flat(batch.column("_text"))
        ids, ths = batch.column("_id").to_numpy(), batch.column("_th").to_numpy()
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK, "right")) - 1)
            pieces = [(offs[a : b + 1] - offs[a], offs[a], offs[b], 0)]
            if offs[b] - offs[a] > BLOCK:  # one long text
                size = offs[b] - offs[a]
                pieces = [(np.array([0, min(BLOCK, size - k)]), offs[a] + k, offs[a] + min(k + BLOCK, size), k) for k in range(0, size, BLOCK - LENGTH + 1)]
            for own, lo, hi, shift in pieces:
                text, start, count, name, place = runs(data[lo:hi], own)
                if len(text):
                    yield pa.record_batch([pa.array(name), pa.array(ids[a + text]), pa.array(ths[a + text]), pa.array(start + shift), pa.array(count.astype(np.int32)), pa.array(place.astype(np.int32))], schema=_RUNS)
            a = b


_PARTS = pa.schema([("name", pa.int64()), ("many", pa.bool_()), ("_id", pa.int64()), ("_th", pa.int64()), ("lo", pa.int64()), ("o", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("bytes", pa.binary())])
_PARTS_DDL = "name long, many boolean, _id long, _th long, lo long, o int, a int, b int, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each run; anchors may lie anywhere from a = 0 to before b = WIDTH in its windows."""
    for batch in batches:
        for k in range(batch.num_rows):
            data = unzip(batch.column("zipped")[k].as_py())
            runs_here = batch.column("runs").slice(k, 1).flatten()
            lo, n = runs_here.field("lo").to_pylist(), runs_here.field("n").to_pylist()
            cut = pa.array([data[a : a + m - 1 + LENGTH] for a, m in zip(lo, n, strict=True)], pa.binary())
            same = [pa.array(np.full(len(lo), batch.column(c)[k].as_py())) for c in ("_id", "_th")]
            ends = [pa.array(np.full(len(lo), x, np.int32)) for x in (0, WIDTH)]
            yield pa.record_batch([runs_here.field("name"), runs_here.field("many"), *same, runs_here.field("lo"), runs_here.field("o"), *ends, cut], schema=_PARTS)


def halves(o: int, a: int, b: int, data: bytes) -> list[tuple[int, int, int, int, bytes]]:
    """Of a context whose first window has its anchor at ``o``, all anchors from a to before b: (first window, a, b, bytes, core) of each half.

    The core is what all windows with an anchor there have in common."""
    n, mid = len(data) - LENGTH + 1, (a + b) // 2 if b - a > 1 else a
    k = min(max(o - mid + 1, 0), n)  # windows whose anchor lies at mid or after come first
    out = []
    for x, y, low, high in ((0, k, mid, b), (k, n, a, mid)):
        if y > x:
            part, at = data[x : y - 1 + LENGTH], o - x
            out.append((x, low, high, part, part[at - low : at - high + 1 + LENGTH]))
    return out


def _refine(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _PARTS]
            for name, many, i, th, lo, o, a, b, data in zip(*(batch.column(f.name).to_pylist() for f in _PARTS), strict=True):
                for x, low, high, part, core in halves(o, a, b, data):
                    new = xxhash.xxh3_64_intdigest(core + name.to_bytes(8, "little", signed=True) + low.to_bytes(2, "little"), level) - 2**63
                    for c, v in zip(out, (new, many, i, th, lo + x, o - x, low, high, part), strict=True):
                        c.append(v)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _PARTS, strict=True)], schema=_PARTS)

    return run


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros after the end)."""
    n = len(data)
    padded = np.zeros(-(-n // 8) * 8 + 16, np.uint8)
    padded[:n] = data
    out = np.empty(len(padded) - 8, np.uint64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(np.uint64)
    return out[:n]


def adjacent_equal(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each two neighbours in ``order`` whether their LENGTH bytes are the same; from the end, where neighbours differ first."""
    word = _words(data)
    live = np.arange(max(0, len(order) - 1))
    for off in range(LENGTH - 8, -1, -8):
        live = live[word[order[live] + off] == word[order[live + 1] + off]]
    out = np.zeros(max(0, len(order) - 1), bool)
    out[live] = True
    return out


def repeated_windows(spans: list[bytes], many: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each span, which of its windows repeat: elsewhere among the spans, or because the span itself is ``many``.

    ``place``: a number for where each span's first byte lies; windows at one place are the same window."""
    size = np.array([len(s) for s in spans], np.int64)
    first = np.cumsum(size + 1) - (size + 1)
    data = np.frombuffer(b"\0".join([*spans, b""]), np.uint8)
    s = data.astype(np.int64) + 2  # bytes count from 2; 1 ends a span
    s[first + size] = 1
    owner = np.repeat(np.arange(len(spans)), size + 1)
    inner = np.arange(len(data)) - first[owner]
    order = suffix_order(s, LENGTH)
    order = order[inner[order] <= size[owner[order]] - LENGTH]
    at = place[owner[order]] + inner[order]
    fresh = np.append(True, ~adjacent_equal(data, order)) if len(order) else np.empty(0, bool)
    group = np.cumsum(fresh) - 1
    low = np.minimum.reduceat(at, np.flatnonzero(fresh)) if len(at) else at
    high = np.maximum.reduceat(at, np.flatnonzero(fresh)) if len(at) else at
    twice = (low != high) | (np.bincount(group, weights=many[owner[order]], minlength=len(low)) > 0 if len(at) else np.empty(0, bool))
    hit = np.zeros(len(s), bool)
    hit[order[twice[group]]] = True
    return [hit[a : a + n - LENGTH + 1] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


_FOUND = pa.schema([("_id", pa.int64()), ("_th", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    """Byte ranges of the repeated windows of (many, _id, _th, lo, bytes) rows."""
    docs = {d: k for k, d in enumerate(dict.fromkeys((r[1], r[2]) for r in rows))}
    place = np.array([(docs[r[1], r[2]] << 40) + r[3] for r in rows], np.int64)
    out: list[list] = [[], [], [], []]
    for (_, i, th, lo, _b), hit in zip(rows, repeated_windows([r[4] for r in rows], np.array([r[0] for r in rows], bool), place), strict=True):
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            for c, v in zip(out, (i, th, lo + a, lo + b - 1 + LENGTH), strict=True):
                c.append(v)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by name: whole names of two contexts or more are gathered into portions and each portion is suffix-sorted."""
    portion: list[tuple] = []
    own: list[tuple] = []  # rows of the current name
    size, name = 0, None

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal portion, size
        if len(own) > 1:
            need = sum(len(x[4]) + 1 for x in own)
            if portion and size + need > PORTION:
                yield _ranges(portion)
                portion, size = [], 0
            portion += own
            size += need

    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("name", "many", "_id", "_th", "lo", "bytes")), strict=True):
            if r[0] != name:
                yield from close()
                name, own = r[0], []
            own.append(r[1:])
    yield from close()
    if portion:
        yield _ranges(portion)


def different(parts: DataFrame, step: str) -> tuple[DataFrame, DataFrame]:
    """(one of each name's equal contexts, the byte ranges of all that have an equal one). Equal is equal in all bytes."""
    # any of the equal ones may go on, as all are many; first values of one row, in fixed-width buffers, so that Spark hashes instead of sorting
    same = parts.groupBy("name", "bytes").agg((F.max("many") | (F.count("*") > 1)).alias("many"), *(F.first(c).alias(c) for c in ("_id", "_th", "lo", "o", "a", "b")))
    one = written(same, f"contexts-{step}")
    copies = parts.join(one.where("many").select("name", "bytes"), ["name", "bytes"])
    return one.select([f.name for f in _PARTS]), copies.select("_id", "_th", F.col("lo").alias("start"), (F.col("lo") + F.length("bytes")).alias("stop"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, start, stop): byte ranges to remove; ranges of one document may overlap."""
    own = keyed(docs, id_col, text_col)
    found = written(own.mapInArrow(_anchors, "name long, _id long, _th long, lo long, n int, o int"), "anchors")
    # written, so that the join reads both sides from a shuffle and a hot name's partition can be split
    names = written(found.groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name"), "names")
    # a row that repeats has the same runs again: one of them goes on, as many. The keys aren't the join's, which leaves adaptive execution free to split it
    runs_ = found.join(names, "name").groupBy("_id", "_th", "lo").agg((F.count("*") > 1).alias("many"), *(F.min(c).alias(c) for c in ("name", "n", "o")))
    wanted = written(runs_.groupBy("_id", "_th").agg(F.collect_list(F.struct("name", "many", "lo", "n", "o")).alias("runs")), "repeated-anchors")
    texts = sieved(own, Sieve(wanted.select("_id", "_th"))).dropDuplicates(["_id", "_th"]).join(wanted, ["_id", "_th"])
    parts = written(texts.mapInArrow(_contexts, _PARTS_DDL), "context-bytes")
    out, level = None, 0
    while True:
        one, copies = different(parts, str(level))
        out = copies if out is None else out.union(copies)
        size = one.groupBy("name").agg(F.sum(F.length("bytes") + 1).alias("size"), F.count("*").alias("c")).where(F.col("size") > PORTION).where("c > 1")
        hot = written(size.select("name"), "hot-names")
        last = hot.isEmpty()
        few = one if last else one.join(hot, "name", "left_anti")
        sorted_ = few.select("name", "many", "_id", "_th", "lo", "bytes").repartition("name").sortWithinPartitions("name")
        out = out.union(sorted_.mapInArrow(_sort, "_id long, _th long, start long, stop long"))
        if last:
            return out
        level += 1
        parts = written(one.join(hot, "name", "left_semi").select([f.name for f in _PARTS]).mapInArrow(_refine(level), _PARTS_DDL), f"halves-{level}")


_KEPT = "_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def _kept(ids: pa.Array, sizes: list[int], removed: list[int], spans: list[int], kept: list) -> pa.RecordBatch:
    digests = pa.array([hashlib.sha256(b).hexdigest() for b in kept], pa.string())
    return pa.record_batch([ids, *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary()), digests], names=["_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, spans, sizes = [], [], [], []
        for k, packed in enumerate(batch.column("zipped").to_pylist()):
            data = unzip(packed)
            ranges = batch.column("ranges")[k]
            sizes.append(len(data))
            if not ranges.is_valid:
                kept.append(data)
                removed.append(0)
                spans.append(0)
                continue
            own = batch.column("ranges").slice(k, 1).flatten()
            start, stop = own.field("start").to_numpy(), own.field("stop").to_numpy()
            order = np.argsort(start, kind="stable")
            start, stop = start[order], np.maximum.accumulate(stop[order])
            fresh = np.append(True, start[1:] > stop[:-1])
            lo, hi = start[fresh], stop[np.append(np.flatnonzero(fresh)[1:] - 1, len(stop) - 1)]
            bounds = np.concatenate([[0], np.column_stack([lo, hi]).ravel(), [len(data)]]).tolist()
            kept.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)))
            removed.append(int((hi - lo).sum()))
            spans.append(len(lo))
        yield _kept(batch.column("_id"), sizes, removed, spans, kept)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = flat(batch.column("_text"))
        view, ends = memoryview(np.ascontiguousarray(data)), offs.tolist()
        texts = [view[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        none = [0] * len(texts)
        yield _kept(batch.column("_id"), [len(t) for t in texts], none, none, [bytes(t) for t in texts])


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256), one row per row of ``docs``."""
    ranges = repeated_ranges(docs, id_col, text_col).groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    ranges = written(ranges, "ranges")
    own, sieve = keyed(docs, id_col, text_col), Sieve(ranges.select("_id", "_th"))
    cut = sieved(own, sieve).join(ranges, ["_id", "_th"], "left").mapInArrow(_cut, _KEPT)
    return cut.union(passing(own, sieve, False, _whole, _KEPT))
