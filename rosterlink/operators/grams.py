"""Threshold search by an inverted index over pairs of neighbouring characters, without loss.

Texts of n and m characters with a common subsequence of c share at least 3c - n - m - 1 neighbouring pairs: a subsequence has c - 1 neighbours, and each
character outside it parts at most one of them.  So a score fixes how many pairs two texts must share, and if that is at least one, they share one of the
rarest of each: all but as many as they must share, less one.  These are the keys on which queries and choices meet, an equi-join that grows with both sides and not with their product.

Two texts are compared only where the rarest pair that they share by those keys has sent them, so no result comes twice.  There the number of shared pairs is counted from the
index first, and what reaches the least number is scored.  Frequent keys are dealt into blocks of both sides.  Texts too short to be sure of a
shared pair are left to the caller.

Pairs are hashed into classes, which can only raise what two texts seem to share; repeated ones in a text are numbered."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Choices, points_of

CLASSES, TIMES = 4096, 16
BUCKETS = 256
QUERY_BLOCK, CHOICE_BLOCK = 4096, 1 << 14
FOUND = "row long, ord long, kind int, nth int, score double"


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbered classes of all pairs of neighbours, and where those of each text start (and the end)."""
    points, sizes = points_of(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(points) else np.empty(0, np.int64)
    mixed = points[inner].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + points[inner + 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) if len(inner) else np.empty(0, np.uint64)
    grams = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(CLASSES)).astype(np.int64)
    own = owner[inner]
    order = np.lexsort((grams, own))
    fresh = np.r_[True, (np.diff(own[order]) != 0) | (np.diff(grams[order]) != 0)] if len(order) else np.empty(0, bool)
    at = np.arange(len(order))
    times = np.empty(len(order), np.int64)
    times[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return grams + CLASSES * times, np.r_[0, np.cumsum(np.maximum(sizes - 1, 0))]


def least_common(total: np.ndarray | int, threshold: float) -> np.ndarray:
    """The shortest common subsequence with which texts of so many characters together reach the threshold."""
    return np.ceil(np.asarray(total) * (threshold / 200.0) - 1e-9).astype(np.int64)


def least_shared(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """What a text of that size must share with any text that it can reach the threshold with, at least."""
    total = sizes + np.ceil(sizes * threshold / (200.0 - threshold) - 1e-9)
    return np.floor((0.015 * threshold - 1) * total - 1 + 1e-9).astype(np.int64)


def short_size(threshold: float) -> int | None:
    """Texts below this size may share nothing; None: texts of any size may."""
    if 0.015 * threshold - 1 <= 1e-6:
        return None
    n = 0
    while least_shared(np.array([n]), threshold)[0] < 1:
        n += 1
    return n


class Ordered:
    """The tokens of texts, the rarest of each text first, and how many of them are its keys."""

    def __init__(self, texts: list[str], rank: np.ndarray, threshold: float) -> None:
        tokens, self.starts = tokens_of(texts)
        own = np.repeat(np.arange(len(texts)), np.diff(self.starts))
        place = np.where(tokens < len(rank), rank[np.minimum(tokens, len(rank) - 1)], 0)
        self.tokens = tokens[np.lexsort((tokens, place, own))]
        n = np.diff(self.starts)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.keys = np.clip(n - np.maximum(least_shared(self.sizes, threshold), 1) + 1, 0, n)
        self.owner = own
        self.is_key = np.arange(len(tokens)) - self.starts[own] < self.keys[own]


def bucket_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens * 2654435761 >> 7) % BUCKETS


def ranks(choices: DataFrame) -> np.ndarray:
    """How often each token occurs, as an order: a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * TIMES, np.int64)
        for batch in batches:
            tokens, _ = tokens_of(batch.column(0).to_pylist())
            total += np.bincount(tokens[tokens < len(total)], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["token", "n"])

    rows = choices.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()  # CLASSES * TIMES rows at most
    out = np.zeros(CLASSES * TIMES, np.int64)
    out[[r["token"] for r in rows]] = [r["n"] for r in rows]
    return out


def keyed(rows: DataFrame, text: str, rank: np.ndarray, threshold: float) -> DataFrame:
    """Each row once for each bucket that one of its text's keys is in."""
    names = [*rows.columns, "bucket"]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Ordered(batch.column(at).to_pylist(), rank, threshold)
            pairs = np.unique(own.owner[own.is_key] * BUCKETS + bucket_of(own.tokens[own.is_key]))
            for a in range(0, len(pairs), 1 << 16):
                some = pairs[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some // BUCKETS)).columns, pa.array((some % BUCKETS).astype(np.int32))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, bucket int")


def meeting(rank: np.ndarray, threshold: float, counting: bool):
    """A task over a bucket's queries and choices; counting: how many pairs met, were counted and were scored, instead of the results."""

    def task(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rows, ats, scores, numbers = [], [np.empty(0, np.int64)], [np.empty(0)], [left.num_rows * right.num_rows, 0, 0]
        if left.num_rows and right.num_rows:
            texts = left["query"].to_pylist()
            asked, held = Ordered(texts, rank, threshold), Choices(right["text"].to_pylist())
            own = Ordered(held.texts, rank, threshold)
            order = np.argsort(own.tokens, kind="stable")
            tokens, owner, is_key = own.tokens[order], own.owner[order], own.is_key[order]
            first, last = np.searchsorted(tokens, asked.tokens, "left"), np.searchsorted(tokens, asked.tokens, "right")
            for i, query in enumerate(texts):
                part = slice(asked.starts[i], asked.starts[i + 1])
                n = last[part] - first[part]
                nth = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(nth)) + np.repeat(first[part] - (np.cumsum(n) - n), n)
                by_key = (nth < asked.keys[i]) & is_key[place]
                met, at = np.unique(owner[place[by_key]], return_index=True)  # the first: the rarest
                met = met[bucket_of(asked.tokens[part][nth[by_key][at]]) == bucket]
                shared = np.bincount(owner[place], minlength=right.num_rows)
                numbers[1] += len(met)
                total = len(query) + own.sizes[met]
                common = least_common(total, threshold)
                met = met[(shared[met] >= 3 * common - total - 1) & (np.minimum(len(query), own.sizes[met]) >= common)]
                numbers[2] += len(met)
                if len(met):
                    found = held.scores(query, met)
                    good = found >= threshold
                    rows.append(np.full(int(good.sum()), i))
                    ats.append(met[good])
                    scores.append(found[good])
        if counting:
            return pa.table({c: pa.array([x], pa.int64()) for c, x in zip(("met", "counted", "scored"), numbers, strict=True)})
        at = pa.array(np.concatenate(ats), pa.int64())
        row = left["row"].take(pa.array(np.concatenate([np.empty(0, np.int64), *rows]), pa.int64()))
        return pa.table({"row": row, **{c: right[c].take(at) for c in ("ord", "kind", "nth")}, "score": pa.array(np.concatenate(scores), pa.float64())})

    return task


def within(asked: DataFrame, choices: DataFrame, threshold: float, counting: bool = False) -> DataFrame:
    """(row, query) and (ord, kind, nth, text), no nulls, both written -> FOUND: all pairs at the threshold or above of which one text at least is not short (see short_size)."""
    rank = ranks(choices)
    sides = [keyed(asked.select("row", "query"), "query", rank, threshold), keyed(choices.select("ord", "kind", "nth", "text"), "text", rank, threshold)]
    blocks = []
    for side, most in zip(sides, (QUERY_BLOCK, CHOICE_BLOCK), strict=True):
        counts = dict.fromkeys(range(BUCKETS), 0) | {r["bucket"]: r["n"] for r in side.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # BUCKETS rows at most
        blocks.append([max(1, math.ceil(counts[b] / most)) for b in range(BUCKETS)])
    nq, nc = (F.element_at(F.array(*map(F.lit, x)), F.col("bucket") + 1) for x in blocks)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = sides[0].withColumn("qb", F.pmod(F.xxhash64("row"), nq).cast("int")).withColumn("cb", every(nc))
    right = sides[1].withColumn("cb", F.pmod(F.xxhash64("ord", "kind", "nth"), nc).cast("int")).withColumn("qb", every(nq))
    n = min(1 << 16, sum(a * b for a, b in zip(*blocks, strict=True)))
    n = min(n, 4 * asked.sparkSession.sparkContext.defaultParallelism) if n == BUCKETS else n
    key = ("bucket", "qb", "cb")
    met = left.repartition(n, *key).groupBy(*key).cogroup(right.repartition(n, *key).groupBy(*key))
    return met.applyInArrow(meeting(rank, threshold, counting), "met long, counted long, scored long" if counting else FOUND)
