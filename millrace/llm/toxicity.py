"""Toxicity (operator 5): a convolutional text classifier in numpy.

Method: every word and its first five bytes are hashed; hashes seen in ``LEAST_DOCS`` training texts or more
have a row in an embedding table of at most ``ROWS`` rows (those of strongest log-odds and most texts first), all others share a row of zeros; filters of widths 1, 2 and 3 slide over the
words, each filter's greatest response in the text is pooled, and a logistic layer weighs the pooled responses. All
weights, embeddings included, are trained by Adam on minibatches; gradients reach only the words that won the pooling. The
first embedding dimension starts from the smoothed log-odds of the hashed words in the training rows, the rest at random from a
fixed seed. A slice of the training rows is kept for calibration: the score is a logistic function of the network's
output, set so that the best threshold over all languages lies at 0.7; each language with enough rows also gets a threshold of its own for
``flagged``. Language never enters a score.

Scale. Every labelled row that isn't held out is learned from (``SAMPLE_WORDS`` lets a caller bound them; there is no bound by default). In how many texts a hash occurs is counted by Spark. Their texts are kept apart from the others by a Bloom filter of at most 8 MB before they are moved. The rows are dealt by a hash of their ids to
blocks of about ``SHARE`` rows, four bytes a word. In each epoch every block trains a copy of the model on its own minibatches, and the copies are brought together: the mean of the dense weights by rows, and of an embedding
over the blocks that met its word; sums are of whole numbers, so the order they come in doesn't matter. One block is plain training. Thresholds are set from all rows kept for calibration, counted by their outputs in steps of 1/``GRID``. The driver
holds the model (about 2 MB, broadcast, with as much for Adagrad's sums) and these counts, whatever the rows. Scoring is one pass without shuffle over whole texts: words are hashed ``BLOCK`` bytes at a time, a very long
text holds 8 bytes a word, and its pooled maxima are carried from slice to slice.

Defined cases: null or empty text has no words: all pooled responses are 0 and the score is the constant part's; without rows of both
labels nothing is learned and every score is 0; null labels aren't used; of an id's texts one is learned from (that of smallest digest), and all are scored, row by row; a run of more than ``BLOCK`` bytes without anything but letters counts as
several words; equal texts, ties and repeated rows have equal scores;
other columns pass through, one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import BYTE_CODES, Rolling, Sieve, flat, mix, pieces, row_id, small_batches, unpacked, written

SAMPLE_WORDS: int | None = None  # no bound; else as many rows as have so many words together are learned from, none with over an eighth of that
SHARE, SHARE_WORDS = 3000, 4_000_000  # of a block: rows on average, words at most (but for one text's)
GRID, FIXED = 1024, 2.0**32
ROWS, LEAST_DOCS = 1 << 16, 3
DIM, FILTERS, WIDTHS = 8, 6, (1, 2, 3)
PREFIX = 5
DECIDE = 0.7
EPOCHS, BATCH, RATE = 6, 64, 0.02
SLICE = 150_000  # words scored at once
BLOCK = 250_000  # bytes hashed at once

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_CODES = BYTE_CODES[_FOLD]


def _hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ink = _LETTER[data]
    edge = np.zeros(len(data), bool)
    edge[offs[(offs > 0) & (offs < len(data))]] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:]
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    r = Rolling(data, _CODES)
    word = mix(r.slices(start, stop))
    prefix = mix(r.slices(start, np.minimum(stop, start + PREFIX)) ^ np.uint64(0x5BD1E995))
    return word, prefix, np.diff(np.searchsorted(start, offs))


def _blocks(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, bytes, offsets) of at most BLOCK bytes; a longer text in several, cut before a byte that is no letter."""
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK, "right")) - 1)
        lo, stop = int(offs[a]), int(offs[b])
        while stop - lo > BLOCK:
            other = np.flatnonzero(~_LETTER[data[lo + 1 : lo + BLOCK]])
            cut = lo + 1 + int(other[-1]) if len(other) else lo + BLOCK
            yield a, a + 1, data[lo:cut], np.array([0, cut - lo])
            lo = cut
        yield a, b, data[lo:stop], np.maximum(offs[a : b + 1] - lo, 0)
        a = b


def word_hashes(data: np.ndarray, offs: np.ndarray, to: Callable[[np.ndarray], np.ndarray] = lambda h: h) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, prefix hashes, words of each text): runs of letters, digits and non-ASCII bytes, ASCII case folded. ``to`` is applied block by block."""
    count = np.zeros(len(offs) - 1, np.int64)
    words, prefixes = [to(np.empty(0, np.uint64))], [to(np.empty(0, np.uint64))]
    for a, b, own, at in _blocks(data, offs):
        if len(own):
            word, prefix, n = _hashes(own, at)
            words.append(to(word))
            prefixes.append(to(prefix))
            count[a:b] += n
    return np.concatenate(words), np.concatenate(prefixes), count


@dataclass
class Model:
    known: np.ndarray  # sorted hashes; the first row of the table, all zeros, is for those not among them
    table: np.ndarray
    kernel: np.ndarray  # DIM x (filters of width 1, then of each place of width 2, then of width 3)
    bias: np.ndarray
    weight: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    middle: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return (np.where(self.known[at] == hashes, at + 1, 0) if len(self.known) else np.zeros(len(hashes))).astype(np.int32)

    def responses(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Filter responses at every place of a run of words; the last places of the wider filters are -inf."""
        x = (self.table[word] + self.table[prefix]) @ self.kernel
        out = np.full((len(word), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        col = 0
        for k, w in enumerate(WIDTHS):
            n = len(word) - w + 1
            if n > 0:
                own = x[:n, col : col + FILTERS].copy()
                for j in range(1, w):
                    own += x[j : j + n, col + j * FILTERS : col + (j + 1) * FILTERS]
                out[:n, k * FILTERS : (k + 1) * FILTERS] = own
            col += w * FILTERS
        return out

    def pooled(self, word: np.ndarray, prefix: np.ndarray, count: np.ndarray, where: bool = False):
        """Greatest responses of each text (-inf without any), and with ``where`` the places that had them."""
        out = np.full((len(count), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        at = np.zeros(out.shape, np.int64)
        ends = np.cumsum(count)
        a = 0
        while a < len(count):
            begin = int(ends[a] - count[a])
            b = max(a + 1, int(np.searchsorted(ends, begin + SLICE, "right")))
            stop = int(ends[b - 1])
            if b == a + 1 and count[a] > SLICE:
                for k in range(begin, stop, SLICE):  # a long text, with an overlap for the wider filters
                    r = self.responses(word[k : min(stop, k + SLICE + WIDTHS[-1] - 1)], prefix[k : min(stop, k + SLICE + WIDTHS[-1] - 1)])
                    best = r.max(axis=0)
                    if where:
                        at[a] = np.where(best > out[a], k + r.argmax(axis=0), at[a])
                    out[a] = np.maximum(out[a], best)
            elif stop > begin:
                r = self.responses(word[begin:stop], prefix[begin:stop])
                own = count[a:b]
                last = ends[a:b][own > 0] - begin
                first = last - own[own > 0]
                for k, w in enumerate(WIDTHS):
                    for j in range(1, w):
                        r[np.maximum(last - j, first), k * FILTERS : (k + 1) * FILTERS] = -np.inf
                best = np.maximum.reduceat(r, first, axis=0)
                out[np.arange(a, b)[own > 0]] = best
                if where:
                    for row, (i, j) in zip(np.arange(a, b)[own > 0], zip(first.tolist(), last.tolist(), strict=True), strict=True):
                        at[row] = begin + i + r[i:j].argmax(axis=0)
            a = b
        return (out, at) if where else out

    def logits(self, word: np.ndarray, prefix: np.ndarray, count: np.ndarray) -> np.ndarray:
        top = self.pooled(word, prefix, count)
        return np.maximum(np.where(np.isfinite(top), top + self.bias, 0), 0) @ self.weight + self.shift

    def scores(self, word: np.ndarray, prefix: np.ndarray, count: np.ndarray) -> np.ndarray:
        z = self.slope * (self.logits(word, prefix, count).astype(np.float64) - self.middle) + np.log(DECIDE / (1 - DECIDE))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _start(words: np.ndarray, prefixes: np.ndarray, count: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Model:
    ends = np.cumsum(count)
    once = [np.unique(np.concatenate([words[b - n : b], prefixes[b - n : b]])) for b, n in zip(ends.tolist(), count.tolist(), strict=True)]
    every, seen_in = np.unique(np.concatenate(once), return_counts=True)
    toxic_hashes, n_toxic = np.unique(np.concatenate([x for x, t in zip(once, y, strict=True) if t > 0]), return_counts=True)
    in_toxic = np.zeros(len(every), np.int64)
    in_toxic[np.searchsorted(every, toxic_hashes)] = n_toxic
    return _begin(every, in_toxic, seen_in - in_toxic, y.sum(), (1 - y).sum(), rng)


def _begin(every: np.ndarray, in_toxic: np.ndarray, in_clean: np.ndarray, toxic: float, clean: float, rng: np.random.Generator) -> Model:
    """The untrained model: ``every`` are sorted hashes with the toxic and clean texts they are in, ``toxic`` and ``clean`` the texts of each label."""
    odds = np.log((in_toxic + 0.5) / (toxic + 1)) - np.log((in_clean + 0.5) / (clean + 1))
    seen = in_toxic + in_clean
    pick = np.flatnonzero(seen >= LEAST_DOCS)
    pick = np.sort(pick[np.argsort(-(np.abs(odds) * np.log1p(seen))[pick], kind="stable")[: ROWS - 1]])
    table = np.zeros((len(pick) + 1, DIM), np.float32)
    table[1:] = rng.normal(0, 0.05, (len(pick), DIM))
    table[1:, 0] = odds[pick] * (seen / (seen + 3))[pick] / 2
    kernel = rng.normal(0, 0.1, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
    kernel[0] = np.abs(kernel[0]) + np.concatenate([np.full(w * FILTERS, 1 / w) for w in WIDTHS])
    n = FILTERS * len(WIDTHS)
    return Model(every[pick], table, kernel, np.full(n, -1, np.float32), np.full(n, 1 / n, np.float32), -1.0)


@dataclass
class State:
    """What training keeps beside the model: Adam's moments of the dense weights, Adagrad's sum of each embedding, steps made."""

    moments: dict[str, list[np.ndarray]]
    second: np.ndarray
    step: float = 0


def _dense(m: Model) -> dict[str, np.ndarray]:
    return {"kernel": m.kernel, "bias": m.bias, "weight": m.weight, "shift": np.array([m.shift], np.float32)}


def _untrained(m: Model) -> State:
    return State({k: [np.zeros_like(v), np.zeros_like(v)] for k, v in _dense(m).items()}, np.zeros(len(m.table), np.float32))


def train(word: np.ndarray, prefix: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 5) -> Model:
    """One block: Adam on minibatches of whole texts; y is 0 or 1."""
    rng = np.random.default_rng(seed)
    m = _start(word, prefix, count, y, rng)
    word, prefix, s = m.rows(word), m.rows(prefix), _untrained(m)
    for _ in range(EPOCHS):
        _epoch(m, s, word, prefix, count, y, rng)
    return m


def _epoch(m: Model, s: State, word: np.ndarray, prefix: np.ndarray, count: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
    """One pass over the texts, in place."""
    ends = np.cumsum(count)
    params = _dense(m)
    cols = np.cumsum([0, *(w * FILTERS for w in WIDTHS)])
    order = rng.permutation(len(count))
    for a in range(0, len(order), BATCH):
        rows = np.sort(order[a : a + BATCH])
        take = np.concatenate([np.arange(ends[r] - count[r], ends[r]) for r in rows]) if len(rows) else rows
        w, p, c, t = word[take], prefix[take], count[rows], y[rows]
        top, at = m.pooled(w, p, c, where=True)
        live = np.isfinite(top)
        act = np.where(live, top + m.bias, 0)
        live &= act > 0
        act = np.maximum(act, 0)
        z = act @ m.weight + m.shift
        d = ((1 / (1 + np.exp(-z))) - t).astype(np.float32) / len(rows)
        d_top = np.where(live, d[:, None] * m.weight, 0).astype(np.float32)
        grads = {"weight": act.T @ d, "shift": np.array([d.sum()], np.float32), "bias": d_top.sum(axis=0), "kernel": np.zeros_like(m.kernel)}
        ids, vals = [], []
        for k, width in enumerate(WIDTHS):
            for f in range(FILTERS):
                col = k * FILTERS + f
                rows_f = np.flatnonzero(d_top[:, col])
                for j in range(width):
                    place, g, kc = at[rows_f, col] + j, d_top[rows_f, col], cols[k] + j * FILTERS + f
                    x = m.table[w[place]] + m.table[p[place]]
                    grads["kernel"][:, kc] += x.T @ g
                    ids += [w[place], p[place]]
                    vals += [g[:, None] * m.kernel[:, kc]] * 2
        s.step += 1
        for k, v in params.items():
            m1, m2 = s.moments[k]
            m1 += 0.1 * (grads[k] - m1)
            m2 += 0.001 * (grads[k] ** 2 - m2)
            v -= (RATE / 2) * (m1 / (1 - 0.9**s.step)) / (np.sqrt(m2 / (1 - 0.999**s.step)) + 1e-6)
        m.shift = float(params["shift"][0])
        if ids:
            every, g = np.concatenate(ids), np.concatenate(vals)
            g[every == 0] = 0
            hit, back = np.unique(every, return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, back, g)
            s.second[hit] += (total**2).mean(axis=1)
            m.table[hit] -= RATE * total / (np.sqrt(s.second[hit])[:, None] + 1e-4)


def _best_cut(z: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """The threshold of least weighted error (a share of clean texts weighs five times as much), in the middle of the widest best gap; z ascends, each with its numbers of toxic and clean texts."""
    wrong = np.append(0, np.cumsum(bad)) / max(1, bad.sum()) + 5 * np.append(np.cumsum(good[::-1])[::-1], 0) / max(1, good.sum())
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(max(((edges[k + 1] - edges[k], (edges[k] + edges[k + 1]) / 2) for k in best))[1])


def _middle(z: np.ndarray, n: np.ndarray) -> float:
    upto = np.cumsum(n)
    return float(z[np.searchsorted(upto, [(upto[-1] + 1) // 2, upto[-1] // 2 + 1])].mean())


def _summed(z: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    each, at = np.unique(z, return_inverse=True)
    return each, np.bincount(at, bad).astype(np.int64), np.bincount(at, good).astype(np.int64)


def calibrate(m: Model, langs: list[str | None], z: np.ndarray, bad: np.ndarray, good: np.ndarray, least: int = 20) -> None:
    """Thresholds from how many toxic and clean texts of each language have an output."""
    every = _summed(z, bad, good)
    m.middle = _best_cut(*every)
    m.slope = float(np.clip(12 / max(1e-3, _middle(every[0], every[1]) - _middle(every[0], every[2])), 0.05, 50))  # the two labels' middles lie 12 apart
    name = np.array([x or "" for x in langs])
    for lang in {x for x in langs if x is not None}:
        own = (name == lang) & np.array([x is not None for x in langs])
        if bad[own].sum() >= least and good[own].sum() >= least:
            cut = _best_cut(*_summed(z[own], bad[own], good[own]))
            m.thresholds[lang] = float(1 / (1 + np.exp(-(m.slope * (cut - m.middle) + np.log(DECIDE / (1 - DECIDE))))))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _labelled(own: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``own`` whose id is known, and few others: the join that follows moves no other texts."""
    hashes = F.xxhash64("_id"), F.xxhash64(F.lit(7), "_id")
    shared = own.sparkSession.sparkContext.broadcast(Sieve(known.select("_id"), hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ok = shared.value.passes(batch.column("h1").to_numpy(), batch.column("h2").to_numpy())
            yield batch.select(["_id", "_t", "_l"]).filter(pa.array(ok))

    return own.withColumns({"h1": hashes[0], "h2": hashes[1]}).mapInArrow(run, own.schema)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, BATCH):
        n = word_hashes(*flat(batch.column("_t")))[2]
        yield pa.record_batch([batch.column("_id"), batch.column("_y"), pa.array(n, pa.int64())], names=["_id", "_y", "n"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic, clean): in how many texts of each label a hash occurs; added up in the task as far as a million go, then by Spark."""
    held: list[tuple[np.ndarray, int]] = []

    def added() -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        y = np.repeat([t for _, t in held], [len(x) for x, _ in held])
        toxic = np.bincount(at, y, len(h)).astype(np.int64)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(h)) - toxic)], names=["h", "toxic", "clean"])

    n = 0
    for batch in pieces(batches, BATCH):
        word, prefix, count = word_hashes(*flat(batch.column("_t")))
        ends = np.cumsum(count)
        for end, own, y in zip(ends.tolist(), count.tolist(), batch.column("_y").to_pylist(), strict=True):
            held.append((np.unique(np.concatenate([word[end - own : end], prefix[end - own : end]])), y))
            n += len(held[-1][0])
        if n > 1_000_000:
            yield added()
            held, n = [], 0
    if held:
        yield added()


_CODED = "share long, _o long, _id long, _y int, n long, w binary, p binary"
_SHARES = "share long, k int, count binary, y binary, w binary, p binary"


def _coded(m: Model):
    """Texts as rows of the embedding table, two bytes a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH):
            word, prefix, count = word_hashes(*flat(batch.column("_t")), lambda h: m.rows(h).astype(np.uint16))
            cut = np.cumsum(count)[:-1]
            own = [pa.array(count, pa.int64()), *(pa.array([x.tobytes() for x in np.split(c, cut)], pa.binary()) for c in (word, prefix))]
            yield pa.record_batch([*(batch.column(c) for c in ("share", "_o", "_id", "_y")), *own], names=["share", "_o", "_id", "_y", "n", "w", "p"])

    return run


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their shares as one row a block; a share of more than SHARE_WORDS words in several."""
    held: list[tuple] = []
    share, k, words = None, 0, 0

    def block() -> pa.RecordBatch:
        count, y = (np.array([r[c] for r in held], t).tobytes() for c, t in ((0, np.int64), (1, np.float32)))
        own = [pa.array([x], t) for x, t in ((share, pa.int64()), (k, pa.int32()), *((x, pa.binary()) for x in (count, y, b"".join(r[2] for r in held), b"".join(r[3] for r in held))))]
        return pa.record_batch(own, names=["share", "k", "count", "y", "w", "p"])

    for batch in pieces(batches, BATCH):
        for r in batch.to_pylist():
            if held and (r["share"] != share or words + r["n"] > SHARE_WORDS):
                yield block()
                k, held, words = k + 1 if r["share"] == share else 0, [], 0
            share = r["share"]
            held.append((r["n"], r["_y"], r["w"], r["p"]))
            words += r["n"]
    if held:
        yield block()


def _vector(m: Model, s: State) -> np.ndarray:
    """The dense weights, their moments and the steps, end to end, and zeros up to a multiple of DIM + 1."""
    flat_ = np.concatenate([*(v.ravel() for v in _dense(m).values()), *(x.ravel() for pair in s.moments.values() for x in pair), [s.step]]).astype(np.float64)
    return np.append(flat_, np.zeros(-len(flat_) % (DIM + 1)))


def _restore(m: Model, s: State, vector: np.ndarray) -> None:
    dense, at = _dense(m), 0
    for v in (*dense.values(), *(x for pair in s.moments.values() for x in pair)):
        v[...] = vector[at : at + v.size].reshape(v.shape)
        at += v.size
    m.shift, s.step = float(dense["shift"][0]), float(vector[at])


_SUMS = "id int, n long, " + ", ".join(f"v{k} long" for k in range(DIM + 1))


def _passes(m: Model, s: State, epoch: int):
    """Every block's epoch from the common model; what the task's blocks changed, added up in whole numbers: embeddings by their row, dense weights under negative ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _vector(m, s)
        dense, rows, total, hits = np.zeros(len(start), np.int64), 0, np.zeros((len(m.table), DIM + 1), np.int64), np.zeros(len(m.table), np.int64)
        for batch in pieces(batches, 1):
            r = batch.to_pylist()[0]
            own = Model(m.known, m.table.copy(), m.kernel.copy(), m.bias.copy(), m.weight.copy(), m.shift)
            state = State({k: [x.copy() for x in pair] for k, pair in s.moments.items()}, s.second.copy(), s.step)
            word, prefix = (np.frombuffer(r[c], np.uint16).astype(np.int32) for c in ("w", "p"))
            count = np.frombuffer(r["count"], np.int64)
            _epoch(own, state, word, prefix, count, np.frombuffer(r["y"], np.float32), np.random.default_rng([5, epoch, r["share"], r["k"]]))
            n = len(count)
            dense += np.rint(_vector(own, state) * FIXED).astype(np.int64) * n
            rows += n
            change = np.column_stack([own.table - m.table, state.second - s.second]).astype(np.float64)
            total += np.rint(change * FIXED).astype(np.int64)
            hits += change.any(axis=1)
        if rows:
            at = np.flatnonzero(hits)
            dense = dense.reshape(-1, DIM + 1)
            ids = np.concatenate([at, -1 - np.arange(len(dense))]).astype(np.int32)
            values = np.concatenate([total[at], dense])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([hits[at], np.full(len(dense), rows)]).astype(np.int64)), *(pa.array(values[:, k].copy()) for k in range(DIM + 1))], names=["id", "n", *(f"v{k}" for k in range(DIM + 1))])

    return run


def _together(m: Model, s: State, sums: pa.Table) -> None:
    """The common model after an epoch."""
    ids, n = sums.column("id").to_numpy(), sums.column("n").to_numpy()
    mean = np.column_stack([sums.column(f"v{k}").to_numpy() for k in range(DIM + 1)]) / n[:, None] / FIXED
    rows, dense = ids >= 0, np.flatnonzero(ids < 0)
    m.table[ids[rows]] += mean[rows, :DIM].astype(np.float32)
    s.second[ids[rows]] += mean[rows, DIM].astype(np.float32)
    _restore(m, s, mean[dense[np.argsort(-ids[dense])]].ravel())


def _outputs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, BATCH):
            z = m.logits(*word_hashes(*flat(batch.column("_t")), m.rows)).astype(np.float64)
            yield pa.record_batch([batch.column("_l"), batch.column("_y"), pa.array(np.rint(z * GRID).astype(np.int64))], names=["_l", "_y", "z"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "toxic") -> Model | None:
    """The model learned from all ``labels`` rows that aren't held out; None without rows of both labels."""
    with small_batches(docs.sparkSession):
        return _fit(docs, labels, id_col, text_col, lang_col, label_col)


def _fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str | None, label_col: str) -> Model | None:
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(row_id(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).distinct()
    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    own = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(row_id(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"), lang.alias("_l"))
    one = F.min_by(F.struct("_l", "_t"), F.struct(F.sha2("_t", 256), "_l"))  # a row an id and label
    every = written(_labelled(own, known).join(known, "_id").groupBy("_id", "_y").agg(one.alias("r")).select("_id", "_y", "r.*", F.xxhash64("_id", F.lit(5)).alias("_o")), "training")
    if SAMPLE_WORDS is not None:
        sizes = every.mapInArrow(_sizes, "_id long, _y int, n long").where(F.col("n") <= SAMPLE_WORDS // 8)
        upto = F.sum(F.greatest("n", F.lit(1))).over(W.orderBy(F.xxhash64("_id", F.lit(5)), "_id", "_y").rowsBetween(W.unboundedPreceding, 0))
        every = every.join(sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_WORDS).select("_id", "_y"), ["_id", "_y"])
    apart = F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(5)) == 4  # for calibration
    n = {(r.apart, r._y): r.n for r in every.groupBy(apart.alias("apart"), "_y").agg(F.count("*").alias("n")).collect()}
    if min(n.get((False, y), 0) + n.get((True, y), 0) for y in (0, 1)) == 0:
        return None
    split = min(n.get((a, y), 0) for a in (False, True) for y in (0, 1)) > 0
    learned = every.where(~apart) if split else every
    clean, toxic = (n.get((False, y), 0) + (0 if split else n.get((True, y), 0)) for y in (0, 1))
    seen = F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    counts = learned.select("_t", "_y").mapInArrow(_counts, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strongest = counts.where(seen >= LEAST_DOCS).orderBy(F.desc(F.abs(odds) * F.log1p(seen)), "h").limit(ROWS - 1).toArrow()
    h = strongest.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    m = _begin(h[order], *(strongest.column(c).to_numpy()[order] for c in ("toxic", "clean")), toxic, clean, np.random.default_rng(5))
    shares = -(-(toxic + clean) // SHARE)
    coded = learned.select(F.pmod("_o", F.lit(shares)).alias("share"), "_o", "_id", "_y", "_t").mapInArrow(_coded(m), _CODED)
    blocks = written(coded.repartition("share").sortWithinPartitions("share", "_o", "_id", "_y").mapInArrow(_shares, _SHARES), "training-blocks")
    s = _untrained(m)
    for epoch in range(EPOCHS):
        sums = blocks.mapInArrow(_passes(m, s, epoch), _SUMS).groupBy("id").agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM + 1)))
        _together(m, s, sums.toArrow())
    # both parts set the threshold where the calibration part is small
    use = every.where(apart) if split and min(n[True, 0], n[True, 1]) >= 20 else every
    z = use.select("_l", "_y", "_t").mapInArrow(_outputs(m), "_l string, _y int, z long").groupBy("_l", "z").agg(F.sum("_y").alias("bad"), F.count_if(F.col("_y") == 0).alias("good")).toArrow()
    calibrate(m, z.column("_l").to_pylist(), z.column("z").to_numpy() / GRID, z.column("bad").to_numpy(), z.column("good").to_numpy())
    return m


def score(docs: DataFrame, model: Model | None, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """``docs`` with all columns, score (double, 0 to 1) and flagged (boolean: over the threshold of the row's language, else 0.7)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in pieces(batches):
            own = batch.column("_row")
            s = m.scores(*word_hashes(*flat(pc.fill_null(own.field(text_col), "")), m.rows)) if m else np.zeros(len(own))
            cuts = np.array([m.thresholds.get(x, DECIDE) for x in own.field(lang_col).to_pylist()]) if m and lang_col else DECIDE
            yield pa.record_batch([own, pa.array(s, pa.float64()), pa.array(s >= cuts)], names=["_row", "score", "flagged"])

    out = T.StructType([rows.schema["_row"], T.StructField("score", T.DoubleType()), T.StructField("flagged", T.BooleanType())])
    return unpacked(rows.mapInArrow(run, out), "score", "flagged")
