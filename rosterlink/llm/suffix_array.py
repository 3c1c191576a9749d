"""Suffix arrays by the difference cover {1, 2} modulo 3, on whole arrays instead of element by element."""

from __future__ import annotations

import numpy as np

MOST = 1 << 21  # triples of names have to fit in 63 bits


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of an array of small non-negative numbers, in order; a prefix comes before what it begins."""
    n = len(text)
    if n > MOST - 4:
        raise ValueError(f"a text of {n} symbols; the most is {MOST - 4}")
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.zeros(n + 4, np.int64)
    s[:n] = text.astype(np.int64) + 1
    width = int(s.max()) + 1
    extra = n % 3 == 1  # the empty suffix then takes part, so that no two sampled halves run into one another
    sampled = np.arange(1, n + extra)
    sampled = sampled[sampled % 3 != 0]
    # sort the sampled triples and name them
    triple = (s[sampled] * width + s[sampled + 1]) * width + s[sampled + 2]
    order = np.argsort(triple, kind="stable")
    fresh = np.ones(len(order), np.int64)
    fresh[1:] = np.diff(triple[order]) != 0
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(fresh)
    if names.max() < len(names):  # recurse on the names: first those at 1 mod 3, then those at 2 mod 3
        ones = sampled % 3 == 1
        both = np.concatenate([sampled[ones], sampled[~ones]])
        deeper = suffix_array(np.concatenate([names[ones], names[~ones]]))
        in_order = both[deeper]
    else:
        in_order = sampled[order]
    rank = np.zeros(n + 4, np.int64)
    rank[in_order] = np.arange(1, len(in_order) + 1)
    in_order = in_order[in_order < n]
    # the others by their first symbol and the rank behind it
    rest = np.arange(0, n, 3)
    many = len(s) + 1
    one_key = s[rest] * many + rank[rest + 1]
    by = np.argsort(one_key, kind="stable")
    rest, one_key = rest[by], one_key[by]
    two_key = (s[rest] * width + s[rest + 1]) * many + rank[rest + 2]
    # merge: how many sampled suffixes of either kind come before each of them
    ones, twos = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    before = np.searchsorted(s[ones] * many + rank[ones + 1], one_key) + np.searchsorted((s[twos] * width + s[twos + 1]) * many + rank[twos + 2], two_key)
    out = np.empty(n, np.int64)
    place = before + np.arange(len(rest))
    free = np.ones(n, bool)
    free[place] = False
    out[place], out[free] = rest, in_order
    return out
