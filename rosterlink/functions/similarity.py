"""Indel similarity of names: 200 * LCS / (sum of lengths), on texts as they are or with their tokens sorted.

The longest common subsequence of one query with many choices at once: bits of the query in 64-bit words, the choices side by
side in arrays, one step for each character position (bit-parallel).  Where bounds leave many choices to be scored, all are, along a tree of
their endings: what several choices end with is gone through once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import WHITE

FIRST, PAIRS, TOGETHER = 64, 4096, 8192
MORE = 4  # times as many as at first are tried next
AT_ONCE = 1 << 21  # pairs of a query and a text whose bounds are held at once
MARKS = 1024
SLACK = 1e-3  # bounds are of single precision
WINDOWS = 1 << 18  # characters of texts and patterns that run together
SLOTS = 1 << 20  # for characters of patterns
BINS = 32
CLASSES = 3 * BINS  # of characters, when texts are counted: those of ASCII that can be seen have one each
BESIDE, STEPS = 16, 128  # queries that go through the tree together; so many of its steps take as long as one pair on its own
CELLS = 1 << 23  # no tree of texts with more characters, each padded to the longest
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def token_sorted(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, f"{WHITE}+"), lambda t: t != "")), " ")


def sort_tokens(text: str) -> str:
    return " ".join(sorted(text.split()))


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and the length of each text."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.int32), np.fromiter(map(len, texts), np.int64, len(texts))


def side_by_side(texts: list[str], empty: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """A column of code points for each text, `empty` beyond its end, and the lengths."""
    points, sizes = points_of(texts)
    codes = np.full((int(sizes.max(initial=0)), len(texts)), empty, np.int32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    codes[np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner] = points
    return codes, sizes


class Choices:
    """Texts laid out for scoring; rows in the order given."""

    def __init__(self, texts: list[str], rows: np.ndarray | None = None) -> None:
        """rows: how many rows have each text, where texts stand for several; they count when the best are counted."""
        self.texts, self.rows = texts, rows
        points, self.sizes = points_of(texts)
        self.alphabet = np.unique(points)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.searchsorted(self.alphabet, points).astype(np.int32)
        self.nth = np.empty(len(texts), np.int32)  # in the order of lengths, the longest first
        self.nth[np.argsort(-self.sizes, kind="stable")] = np.arange(len(texts))
        bins = points % CLASSES * len(texts) + np.repeat(np.arange(len(texts)), self.sizes)
        counts = np.bincount(bins, minlength=len(texts) * CLASSES).reshape(CLASSES, len(texts))
        self.counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        self.levels = self.counts.max(axis=1, initial=0).astype(np.int64)

    @cached_property
    def clipped(self) -> np.ndarray | None:
        """For each class of characters and each number up to the highest one a row: how many each text has, up to that number.  None for texts so long that this would be large."""
        if self.levels.sum() > MARKS:
            return None
        return np.concatenate([np.empty((0, len(self.texts)), self.counts.dtype), *(np.minimum(own, np.arange(1, n + 1, dtype=own.dtype)[:, None]) for own, n in zip(self.counts, self.levels, strict=True))])

    def common(self, query: str) -> np.ndarray:
        """At least the length of each common subsequence: common characters, counted in classes of them."""
        own = np.minimum(np.bincount(points_of([query])[0] % CLASSES, minlength=CLASSES), self.levels)
        has = np.flatnonzero(own)
        if self.clipped is not None:
            return self.clipped[np.cumsum(self.levels)[has] - self.levels[has] + own[has] - 1].sum(axis=0, dtype=np.min_scalar_type(len(query)))
        out = np.zeros(len(self.texts), np.int32)
        for k in has:
            out += np.minimum(self.counts[k], self.counts.dtype.type(own[k]))
        return out

    def bounds(self, query: str) -> np.ndarray:
        """At least the score of each."""
        return ratio(self.common(query), len(query), self.sizes)

    def bounds_of(self, queries: list[str]) -> np.ndarray:
        """At least the score of each query with each text, up to SLACK: common characters, added up in the smallest numbers that hold them."""
        out, length = np.empty((len(queries), len(self.texts)), np.float32), self.sizes.astype(np.float32)
        for query, row in zip(queries, out, strict=True):
            np.multiply(self.common(query), np.float32(200), out=row)
            row /= np.maximum(length + np.float32(len(query)), 1)
            if not query:
                row[self.sizes == 0] = 100
        return out

    def lengths_of(self, queries: list[str], which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences, pair by pair: which of the queries, and the row of the text.

        Pairs run side by side, those of long texts first, so that those whose text has ended are left out of the next steps."""
        out, letters = np.zeros(len(rows), np.int64), len(self.alphabet)
        sizes = np.fromiter(map(len, queries), np.int64, len(queries))
        need = np.maximum(1, -(-sizes // 64))
        for words in np.unique(need).tolist():
            asked = np.flatnonzero(need == words)
            points, n = points_of([queries[i] for i in asked])
            owner, nth = np.repeat(np.arange(len(n)), n), np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
            at = np.minimum(np.searchsorted(self.alphabet, points), letters - 1)
            known = self.alphabet[at] == points if letters else np.zeros(len(points), bool)
            owner, nth, at = owner[known], nth[known], at[known]
            masks = np.zeros((words, len(n) * letters), np.uint64)  # where each character stands in each query
            np.bitwise_or.at(masks, (nth // 64, owner * letters + at), np.uint64(1) << (nth % 64).astype(np.uint64))
            slot = np.full(len(queries), -1)
            slot[asked] = np.arange(len(asked))
            own = np.arange(len(rows)) if len(asked) == len(queries) else np.flatnonzero(slot[which] >= 0)
            own = own[np.argsort(self.nth[rows[own]])]
            for a in range(0, len(own), TOGETHER):
                part = own[a : a + TOGETHER]
                size = self.sizes[rows[part]]
                live = len(part) - np.cumsum(np.bincount(size))[:-1]
                position, base = self.starts[rows[part]], slot[which[part]] * letters
                state, at = np.full((words, len(part)), ALL), np.empty((2, len(part)), np.int64)
                for k in live.tolist():
                    np.add(self.places.take(position[:k], mode="clip"), base[:k], out=at[0, :k])
                    advance(state[:, :k], masks.take(at[0, :k], axis=1, mode="clip") if words > 1 else masks[0].take(at[0, :k], mode="clip")[None])
                    position[:k] += 1
                out[part] = ones_in(state, sizes[which[part]])
        return out

    @cached_property
    def tree(self) -> list[tuple[np.ndarray, ...]] | None:
        """The different endings of the texts, a level for each length: the number of the ending without its first character, that character, and which texts are such an ending, and which.  None where it would be large."""
        if len(self.texts) * int(self.sizes.max(initial=0)) > CELLS:
            return None
        back = [text[::-1] for text in self.texts]
        order = np.array(sorted(range(len(back)), key=back.__getitem__), np.int64)
        codes, sizes = side_by_side([back[i] for i in order])
        same = np.logical_and.accumulate(codes[:, 1:] == codes[:, :-1], axis=0)
        levels, before = [], np.zeros(len(order), np.int64)
        for k, row in enumerate(codes):
            fresh = row >= 0
            fresh[1:] &= ~same[k]
            first, ends, at = np.flatnonzero(fresh), np.flatnonzero(sizes == k + 1), np.cumsum(fresh) - 1
            levels.append((before[first], np.searchsorted(self.alphabet, row[first]), order[ends], at[ends]))
            before = at
        return levels

    def crowded(self, n_pairs: np.ndarray) -> np.ndarray:
        """The queries, given the pairs that each has, of which the tree is the shorter way to the scores."""
        if n_pairs.sum() <= len(self.texts) or self.tree is None:
            return np.empty(0, np.int64)
        return np.flatnonzero(n_pairs * STEPS > sum(len(level[0]) for level in self.tree))

    def all_scores(self, queries: list[str]) -> np.ndarray:
        """The scores of all queries with all texts: (queries, texts).  A subsequence read backwards is one, so both sides are."""
        sizes, letters = np.fromiter(map(len, queries), np.int64, len(queries)), len(self.alphabet)
        need, out = np.maximum(1, -(-sizes // 64)), np.zeros((len(queries), len(self.texts)))
        for words in np.unique(need).tolist():
            asked = np.flatnonzero(need == words)
            for some in np.split(asked, range(BESIDE, len(asked), BESIDE)):
                points, n = points_of([queries[i][::-1] for i in some])
                owner, nth = np.repeat(np.arange(len(n)), n), np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
                at = np.minimum(np.searchsorted(self.alphabet, points), letters - 1)
                known = self.alphabet[at] == points if letters else np.zeros(len(points), bool)
                owner, nth, at = owner[known], nth[known], at[known]
                masks = np.zeros((words, letters, len(some)), np.uint64)
                np.bitwise_or.at(masks, (nth // 64, at, owner), np.uint64(1) << (nth % 64).astype(np.uint64))
                state, common = np.full((words, 1, len(some)), ALL), np.zeros((len(self.texts), len(some)), np.uint32)
                for before, letter, ends, which in self.tree:
                    state = state.take(before, axis=1)
                    advance(state, masks.take(letter, axis=1))
                    if len(ends):
                        common[ends] = ones_in(state[:, which], n)
                out[some] = ratio(np.ascontiguousarray(common.T), n[:, None], self.sizes)
        return out

    def scores_of(self, queries: list[str], which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        sizes = np.fromiter(map(len, queries), np.int64, len(queries))
        return ratio(self.lengths_of(queries, which, rows), sizes[which], self.sizes[rows])

    def lengths(self, query: str, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of query and those rows."""
        return self.lengths_of([query], np.zeros(len(rows), np.int64), rows)

    def scores(self, query: str, rows: np.ndarray) -> np.ndarray:
        return ratio(self.lengths(query, rows), len(query), self.sizes[rows])

    def parts(self, queries: list[str]) -> Iterator[slice]:
        """Queries whose bounds are held at once."""
        step = max(1, AT_ONCE // max(1, len(self.texts)))
        return (slice(a, a + step) for a in range(0, len(queries), step))

    def least_of(self, which: np.ndarray, rows: np.ndarray, scores: np.ndarray, at_least: int, least: np.ndarray) -> np.ndarray:
        """For each query the score that `at_least` of its rows have or pass, the one that is known where they are fewer."""
        some = scores >= least[which]
        which, rows, scores = which[some], rows[some], scores[some]
        order = np.lexsort((-scores, which))
        own, many = which[order], np.ones(len(order), np.int64) if self.rows is None else self.rows[rows[order]]
        many = np.cumsum(many)
        first = np.searchsorted(own, own)
        enough = np.flatnonzero(many - np.r_[0, many][first] >= at_least)
        found, at = np.unique(own[enough], return_index=True)
        out = least.copy()
        out[found] = np.maximum(out[found], scores[order[enough[at]]])
        return out

    def best_of(self, queries: list[str], at_least: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, row and score: for each query those that hold its `at_least` best (ties included) of its least score or more; rows that the bound rules out are not scored."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for part in self.parts(queries):
            some, known = queries[part], least[part]
            bounds, left = self.bounds_of(some), np.arange(len(some))
            which, rows, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for most in (FIRST, MORE * FIRST, None):  # the rows of the highest bounds say what the others must reach
                own, floor = bounds if most == FIRST else bounds[left], (known[left] - SLACK).astype(np.float32)
                fit = own >= floor[:, None]
                many = np.count_nonzero(fit, axis=1)
                if most is None and len(full := self.crowded(many)):
                    asked, tried, every = self.highest(self.all_scores([some[i] for i in left[full]]), at_least, known[left[full]])
                    asked = left[full[asked]]
                    fresh = bounds[asked, tried] > -np.inf  # those before have been scored
                    which, rows, scores = np.r_[which, asked[fresh]], np.r_[rows, tried[fresh]], np.r_[scores, every[fresh]]
                    fit[full] = False
                over = np.flatnonzero(many > most) if most else np.empty(0, np.int64)
                if len(over):
                    least_bound = np.partition(own[over], -most, axis=1)[:, -most]
                    fit[over] = own[over] >= least_bound[:, None]
                    for i in np.flatnonzero(np.count_nonzero(fit[over], axis=1) > 2 * most):  # of many equal bounds some
                        fit[over[i], np.flatnonzero(own[over[i]] == least_bound[i])[most:]] = False
                asked, tried = true_in(fit)
                asked = left[asked]
                bounds[asked, tried] = -np.inf
                which, rows, scores = np.r_[which, asked], np.r_[rows, tried], np.r_[scores, self.scores_of(some, asked, tried)]
                known = self.least_of(which, rows, scores, at_least, known)
                left = left[over]
                if not len(left):
                    break
            good = scores >= known[which]
            out.append((which[good] + part.start, rows[good], scores[good]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def highest(self, scores: np.ndarray, at_least: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of all that may be among the `at_least` best of the least score or more: what the best of some texts reach says so."""
        some = scores[:, ::8]
        reached = np.partition(some, -at_least, axis=1)[:, -at_least] if some.shape[1] >= at_least else np.full(len(scores), -1.0)
        which, rows = true_in(scores >= np.maximum(reached, least)[:, None])
        return which, rows, scores[which, rows]

    def best(self, query: str, at_least: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """best_of for one query: rows and scores."""
        return self.best_of([query], at_least, np.array([least]))[1:]

    def above(self, queries: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, row and score of all pairs at the threshold or above."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for part in self.parts(queries):
            some = queries[part]
            which, rows = true_in(self.bounds_of(some) >= threshold - SLACK)
            if len(full := self.crowded(np.bincount(which, minlength=len(some)))):
                every = self.all_scores([some[i] for i in full])
                by_tree, tried = true_in(every >= threshold)
                out.append((full[by_tree] + part.start, tried, every[by_tree, tried]))
                alone = ~np.isin(which, full)
                which, rows = which[alone], rows[alone]
            scores = self.scores_of(some, which, rows)
            good = scores >= threshold
            out.append((which[good] + part.start, rows[good], scores[good]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def best_partial(self, query: str, least: float = -1.0) -> tuple[np.ndarray, float]:
        """Rows with the highest partial ratio, and that ratio; no rows if it is below the least one asked for.

        A window holds at most what is common to the whole texts: first counted by characters, then, for rows that pass, as a subsequence."""
        short = np.minimum(len(query), self.sizes)
        most = lambda common, short: np.where(short == 0, 100.0, 200.0 * common / np.maximum(short + common, 1))
        bounds = most(self.common(query), short)
        best, rows, left, step = least, [], np.arange(len(self.texts)), MORE * FIRST
        while len(left := left[bounds[left] >= best - 1e-9]):
            order = np.argpartition(-bounds[left], step) if len(left) > step else np.arange(len(left))
            some, left = left[order[:step]], left[order[step:]]
            closer = most(self.lengths(query, some), short[some])
            order = np.argsort(-closer, kind="stable")
            some, closer, a, few = some[order], closer[order], 0, 16
            while a < len(some) and closer[a] >= best - 1e-9:
                part = some[a : a + few][closer[a : a + few] >= best - 1e-9]
                scores = partial_ratios([query] * len(part), [self.texts[i] for i in part])
                if (top := float(scores.max())) > best:
                    best, rows = top, []
                rows += part[scores == best].tolist()
                a, few = a + few, 2 * few
            step *= 2
        return np.sort(np.array(rows, np.int64)), best


def true_in(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero for few: eight flags at a time are looked at first."""
    flat = flags.ravel()
    end = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:end].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.r_[at[flat[at]], np.flatnonzero(flat[end:]) + end], max(1, flags.shape[1]))


def ratio(common: np.ndarray, size: int | np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two empty texts are alike."""
    total = size + sizes
    out = 200.0 * common / np.maximum(total, 1)
    return np.where(total == 0, 100.0, out) if not np.all(total) else out


def advance(state: np.ndarray, masks: np.ndarray) -> None:
    """One character further, in place; state and masks: (words, pairs).  The masks are used up."""
    carry = None
    for s, u in zip(state, masks, strict=True):
        u &= s
        rest = s ^ u
        if len(state) == 1:
            s += u
        else:
            total = s + u
            over = total < s
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            s[:] = total
        s |= rest


def ones_in(state: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many characters of each pattern are in its common subsequence."""
    ones = np.zeros(state.shape[1:], np.int64)
    for w, own in enumerate(state):
        left = np.clip(sizes - 64 * w, 0, 64).astype(np.uint64)
        mask = np.where(left == 64, ALL, (np.uint64(1) << np.minimum(left, np.uint64(63))) - np.uint64(1))
        ones += np.bitwise_count(~own & mask).astype(np.int64)
    return ones


def ones_of(steps, words: int, sizes: np.ndarray) -> np.ndarray:
    """Bit-parallel subsequences: steps are the masks (words, pairs) of where the next character is in each pattern; sizes: the patterns' lengths."""
    state = np.full((words, len(sizes)), ALL)
    for masks in steps:
        advance(state, masks)
    return ones_in(state, sizes)


def pair_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences of the texts of a with those of b, pair by pair."""
    out = [np.empty(0, np.int64)]
    for at in range(0, len(a), PAIRS):
        left, sizes = side_by_side(a[at : at + PAIRS])
        right, _ = side_by_side(b[at : at + PAIRS], -2)
        words = max(1, -(-len(left) // 64))
        padded = np.full((len(sizes), 64 * words), -1, np.int32)
        padded[:, : len(left)] = left.T
        steps = (np.packbits(padded == row[:, None], axis=1, bitorder="little").view("<u8").T for row in right)
        out.append(ones_of(steps, words, sizes))
    return np.concatenate(out)


def pair_ratios(a: list[str], b: list[str]) -> np.ndarray:
    return ratio(pair_lengths(a, b), np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b)))


def laid_bits(patterns: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the texts, one text after the other, where it stands in the text's pattern, as bits: (words, characters); and where it stands counted from behind."""
    (sought, n), (points, m) = points_of(patterns), points_of(texts)
    owner, at = np.repeat(np.arange(len(n)), n), np.arange(len(sought)) - np.repeat(np.cumsum(n) - n, n)
    letter = np.zeros(int(max(sought.max(), points.max())) + 1, np.int64)
    letter[sought] = 1
    letter *= np.cumsum(letter)  # 0: in no pattern
    width = int(letter.max()) + 1
    place, wanted = owner * width + letter[sought], np.repeat(np.arange(len(m)), m) * width + letter[points]
    total = len(n) * width
    if total > SLOTS:  # many kinds of characters: only those that a pattern has
        keys, place = np.unique(place, return_inverse=True)
        found, total = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1), len(keys) + 1
        wanted = np.where(keys[found] == wanted, found, len(keys))
    out = []
    for bit in (at, np.repeat(n, n) - 1 - at):
        known = np.zeros((-(-int(n.max()) // 64), total), np.uint64)
        np.bitwise_or.at(known, (bit // 64, place), np.uint64(1) << (bit % 64).astype(np.uint64))
        out.append(known.take(wanted, axis=1))
    return tuple(out)


def windows(patterns: list[str], texts: list[str]) -> np.ndarray:
    """For each pair the best ratio of the pattern with a window of its length, or with a shorter one at either end of the text.  None of them is empty, no pattern is longer than its text, and patterns ascend by length.

    Windows at the start are what one pass over the text goes through, those at the end what a pass from behind does.  Only windows that touch neither end are gone through one by one, side by
    side, each until its pattern's length is reached."""
    n, m = (np.fromiter(map(len, texts_), np.int64, len(texts_)) for texts_ in (patterns, texts))
    base, live = np.cumsum(m) - m, np.searchsorted(n, np.arange(int(n.max())), "right").tolist()
    best, (forward, backward) = np.zeros(len(n)), laid_bits(patterns, texts)
    left = np.clip(n - 64 * np.arange(len(forward))[:, None], 0, 64).astype(np.uint64)
    own_bits = np.where(left == 64, ALL, (np.uint64(1) << np.minimum(left, np.uint64(63))) - np.uint64(1))
    for bits, start, way in ((forward, base, 1), (backward, base + m - 1, -1)):
        state = np.full((len(bits), len(n)), ALL)
        for j, done in enumerate(live):
            advance(state[:, done:], bits.take(start[done:] + way * j, axis=1))
            common = np.bitwise_count(~state[:, done:] & own_bits[:, done:])
            np.maximum(best[done:], 200.0 * (common[0] if len(common) == 1 else common.sum(axis=0, dtype=np.int64)) / (n[done:] + (j + 1)), out=best[done:])
    count = np.maximum(m - n - 1, 0)
    own = np.repeat(np.arange(len(n)), count)
    position, state = base[own] + 1 + np.arange(len(own)) - (np.cumsum(count) - count)[own], np.full((len(forward), len(own)), ALL)
    for j, done in enumerate(np.searchsorted(n[own], np.arange(int(n[own].max(initial=0))), "right").tolist()):
        advance(state[:, done:], forward.take(position[done:] + j, axis=1))
    np.maximum.at(best, own, ratio(ones_in(state, n[own]), n[own], n[own]))
    return best


def partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """The best ratio of the shorter text with a window of the longer one: windows of its length, and shorter ones at the ends.  Pair by pair; of equal lengths both ways count."""
    out = np.array([100.0 * (x == y) for x, y in zip(a, b, strict=True)])
    ways = [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and len(x) <= len(y)]
    ways += [(i, y, x) for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and len(y) <= len(x)]
    ways.sort(key=lambda way: len(way[1]))  # patterns of like lengths run together
    begin = 0
    while begin < len(ways):
        end, total = begin, 0
        while end < len(ways) and (end == begin or total + len(ways[end][1]) + len(ways[end][2]) <= WINDOWS):
            total += len(ways[end][1]) + len(ways[end][2])
            end += 1
        part = ways[begin:end]
        np.maximum.at(out, [i for i, _, _ in part], windows([s for _, s, _ in part], [t for _, _, t in part]))
        begin = end
    return out


def pair_ratio(a: str, b: str) -> float:
    return float(pair_ratios([a], [b])[0])


def partial_ratio(a: str, b: str) -> float:
    return float(partial_ratios([a], [b])[0])
