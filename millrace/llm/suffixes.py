"""Suffix sorting in numpy: a difference cover modulo 3, as far as a given prefix length matters.

Positions 1 and 2 modulo 3 are sampled; their triples are sorted and named; if names repeat, the string of names is sorted
by the same function; the other suffixes are ordered by their first symbol and the rank of the sampled suffix after it, and
merged in by binary search. A name at depth d stands for 3**d symbols, so recursion ends once names cover ``depth`` symbols:
suffixes that are still tied are equal that far.
"""

from __future__ import annotations

import numpy as np

MOST = (1 << 20) - 8  # symbols: two names and a rank fit in one 64-bit key


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of the keys, the names (from 1) in the order given, and how many names there are."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.empty(len(own), bool)
    new[:1] = True
    new[1:] = own[1:] != own[:-1]
    count = np.cumsum(new)
    names = np.empty(len(own), np.int64)
    names[order] = count
    return order, names, int(count[-1]) if len(own) else 0


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s`` (integers from 1 to 2**20) sorted by the suffixes there, ties equal for at least ``depth`` symbols."""
    n = len(s)
    if n > MOST:
        raise ValueError(f"{n} symbols: at most {MOST} fit one sort")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # for n % 3 == 1 a position past the end closes class 1
    sample = np.concatenate([one, two])
    order, names, count = _names((t[sample] << 42) | (t[np.minimum(sample + 1, n + 2)] << 21) | t[np.minimum(sample + 2, n + 2)])
    if count < len(sample) and depth > 3:
        order = suffix_order(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero_key = (t[zero] << 21) | rank[zero + 1]
    by = np.argsort(zero_key, kind="stable")
    zero, zero_key = zero[by], zero_key[by]
    is_one = sampled % 3 == 1
    first, second = sampled[is_one], sampled[~is_one]
    below = np.searchsorted((t[first] << 21) | rank[first + 1], zero_key)
    below += np.searchsorted((t[second] << 42) | (t[second + 1] << 21) | rank[second + 2], (t[zero] << 42) | (t[zero + 1] << 21) | rank[zero + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + np.maximum.accumulate(below)
    out[at] = zero
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = sampled
    return out
