"""Sets of word shingles as 64-bit hashes, for whole Arrow batches at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .shared import BYTE_CODES, Rolling, flat, mix

WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INK = np.ones(256, bool)
_INK[[32, 9, 10, 11, 12, 13]] = False
_CODES = BYTE_CODES[_LOWER]  # upper-case ASCII letters count as lower-case
_WEIGHTS = mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
BLOCK = 250_000  # bytes hashed at once


def word_spans(data: np.ndarray, offs: np.ndarray, letters: np.ndarray = _INK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of all texts; a text's bounds end a word. letters: which of the 256 bytes stand in words."""
    ink = letters[data]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    inner = offs[(offs > 0) & (offs < len(data))]
    start[inner] = ink[inner]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:]
    stop[inner - 1] = ink[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _mixed(poly: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(poly + size.astype(np.uint64))


def _windows(words: np.ndarray) -> np.ndarray:
    """Hashes of every ``WORDS`` neighbouring words."""
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, np.uint64)
    return mix(sum((words[k : n + k] * _WEIGHTS[k] for k in range(WORDS)), np.zeros(n, np.uint64)))


def _few(words: np.ndarray) -> np.ndarray:
    """The set of a text of fewer than ``WORDS`` words: all of them as one."""
    return mix(np.array([(words * _WEIGHTS[: len(words)]).sum() + np.uint64(len(words))], np.uint64)) if len(words) else words


def _sets(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    n = len(offs) - 1
    if not len(data):
        yield from (np.empty(0, np.uint64) for _ in range(n))
        return
    start, end = word_spans(data, offs)
    words = _mixed(Rolling(data, _CODES).slices(start, end), end - start)
    at = np.searchsorted(start, offs)  # first word of each text
    many = _windows(words)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(many[a : b - WORDS + 1]) if b - a >= WORDS else _few(words[a:b])


def _words_in_blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the words of one text, a block at a time; a word that goes on in the next block is put together from its parts."""
    poly, size = np.zeros(1, np.uint64), 0  # of the word that is open at a block's start
    for a in range(0, len(data), BLOCK):
        own = data[a : a + BLOCK]
        start, end = word_spans(own, np.array([0, len(own)]))
        h, n = Rolling(own, _CODES).slices(start, end), (end - start).astype(np.int64)
        if size and not (len(start) and start[0] == 0):
            h, n = np.append(poly, h), np.append(size, n)
        elif size:
            h[:1] = poly + np.uint64(pow(Rolling.BASE, size, 2**64)) * h[:1]
            n[0] += size
        poly, size = np.zeros(1, np.uint64), 0
        if len(end) and end[-1] == len(own) and a + BLOCK < len(data):
            poly, size, h, n = h[-1:].copy(), int(n[-1]), h[:-1], n[:-1]
        yield _mixed(h, n)
    if size:
        yield _mixed(poly, np.array([size]))


def _long_set(data: np.ndarray) -> np.ndarray:
    """The set of one long text, without arrays of its length: 8 bytes a distinct shingle, twice while they are sorted."""
    tail = np.empty(0, np.uint64)
    found = []
    for words in _words_in_blocks(data):
        words = np.concatenate([tail, words])
        tail = words[max(0, len(words) - WORDS + 1) :]
        found.append(np.unique(_windows(words)))
    every = np.concatenate(found) if found else tail
    del found
    if not len(every):
        return _few(tail)
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (no nulls): ``WORDS`` words each, or all words of a shorter text."""
    data, offs = flat(texts)
    a = 0
    while a < len(offs) - 1:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK, "right")) - 1)
        if offs[b] - offs[a] > BLOCK:  # one long text
            yield _long_set(data[offs[a] : offs[b]])
        else:
            yield from _sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b
