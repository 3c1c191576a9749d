"""MinHash near-dedup with min-max hashing.

Each permutation of a set's shingles gives two signature values, the minimum and the maximum, for one evaluation.  Values of
`rows` different permutations make a band, minima and maxima in bands of their own; so the values of a band are independent and
agree with the Jaccard similarity as their probability.  Sets that share a band's value meet in a bucket.

1. Documents with the same set are one class; its smallest id stands for it.
2. In every bucket all members are compared with its smallest member on their full sets.  That is a row for each member,
   never all pairs.  Links found give components.
3. Where members of a bucket are still in other components than its smallest one, they are compared with the members of other components there,
   unless sizes or distances rule a link out: Jaccard distance is a metric, so two sets whose distances to the
   smallest member differ by more than the allowed distance cannot be linked.  That loses nothing.  Buckets are dealt into blocks of bounded size that meet two by
   two; pairs are never rows, and only links that join components leave a task.
4. Components over all links; the smallest id of each stays.

With 60 permutations and bands of 5 a pair at similarity 0.85 shares no band with probability 8e-7 (bands of 4 at 0.8: 2e-7).

Words are what lies between ASCII white space, A-Z lower-cased.  Null texts and texts without words have an empty set and are linked with
nothing.  Fewer words than a shingle's make one shingle.  Rows with the same id are told apart, rows without an id come last;
other columns are dropped, so their names cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, stored, unique_ids
from .hashing import Spans, mix, raw_bytes, some_at_a_time

PERMUTATIONS = 60
BLOCK_SETS = 1024
BLOCK_BYTES = 4 << 20
HUB_PAIRS = 256
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
_random = np.random.default_rng(77)
_times = _random.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_plus = _random.integers(0, 1 << 64, 256, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the number of the first, the hashes of all words, where each text's words start and the last end."""
    data, offsets = raw_bytes(texts)
    for a, b in some_at_a_time(offsets):
        part = np.full(int(offsets[b] - offsets[a]) + (b - a), 32, np.uint8)  # a space behind each text
        own = offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)
        keep = np.ones(len(part), bool)
        keep[own[1:] - 1] = False
        part[keep] = _lower[data[offsets[a] : offsets[b]]]
        word = ~_space[part]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        yield a, Spans(part).hashes(starts, ends), np.searchsorted(starts, own)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts at a time: the number of the first, the sorted distinct shingles of each in a row, where each set starts and the last ends."""
    for a, hashes, first in word_hashes(texts):
        sets = []
        if len(hashes) >= k:
            rolled = np.zeros(len(hashes) - k + 1, np.uint64)
            for j in range(k):
                rolled += hashes[j : len(rolled) + j] * _times[j]
            rolled = mix(rolled)
        for x, y in zip(first, first[1:], strict=False):
            if y - x >= k:
                sets.append(np.unique(rolled[x : y - k + 1]))
            elif y > x:
                sets.append(mix(np.sum(hashes[x:y] * _times[32 : 32 + y - x], keepdims=True) + _plus[y - x : y - x + 1]))
            else:
                sets.append(np.empty(0, np.uint64))
        bounds = np.zeros(len(sets) + 1, np.int64)
        np.cumsum([len(s) for s in sets], out=bounds[1:])
        yield a, np.concatenate(sets), bounds


def bands_of(values: np.ndarray, bounds: np.ndarray, rows: int) -> np.ndarray:
    """For each set (none empty) its bands: minima of `rows` permutations, then maxima."""
    low, high = [], []
    starts = bounds[:-1]
    for p in range(PERMUTATIONS):
        moved = values * _times[64 + p] + _plus[64 + p]
        low.append(np.minimum.reduceat(moved, starts))
        high.append(np.maximum.reduceat(moved, starts))
    out = []
    for values_of in (low, high):
        for at in range(0, PERMUTATIONS - rows + 1, rows):
            band = np.zeros(len(starts), np.uint64)
            for j in range(rows):
                band = mix(band + values_of[at + j] * _times[128 + j])
            out.append(band)
    return np.stack(out, axis=1)


def signatures(rows: DataFrame, k: int, band_rows: int) -> DataFrame:
    """(rid, text) -> (rid, n, d1, d2, bands): the size of the set, 128 bits that tell sets apart, the bands (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, bounds in shingle_sets(batch.column(1), k):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                bands = np.empty((0, 0), np.uint64)
                if len(full):
                    starts = bounds[:-1][full]
                    d1[full] = np.add.reduceat(mix(values), starts)
                    d2[full] = np.add.reduceat(mix(values * _times[200] + _plus[200]), starts)
                    bands = bands_of(values, np.append(starts, bounds[-1]), band_rows)
                width = bands.shape[1] if len(full) else 0
                lists = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, width, 0), out=lists[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(bands.ravel().view(np.int64)))],
                    names=["rid", "n", "d1", "d2", "bands"])

    return rows.mapInArrow(run, "rid long, n long, d1 long, d2 long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """pairs (a, b) -> (a, b, both, either): sizes of the intersection and the union of the full sets.

    Both sides of these joins grow with the corpus, so they are sort-merge joins at any size.  A hub b of many pairs has a copy of its text for every HUB_PAIRS of them, and its pairs are
    dealt out among the copies: each of those rows holds a whole text already, so all of a hub's in one task would be a large part of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ids, at = np.unique(np.concatenate([a, b]), return_index=True)
            sets: dict[int, np.ndarray] = {}
            every = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(at))
            for first, values, bounds in shingle_sets(every, k):
                for j in range(len(bounds) - 1):
                    sets[int(ids[first + j])] = values[bounds[j] : bounds[j + 1]]
            both = np.empty(len(a), np.int64)
            either = np.empty(len(a), np.int64)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                x, y = sets[x], sets[y]
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                place = np.searchsorted(large, small)
                place[place == len(large)] = 0
                both[i] = np.count_nonzero(large[place] == small) if len(large) else 0
                either[i] = len(x) + len(y) - both[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both), pa.array(either)], names=["a", "b", "both", "either"])

    left, right = texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), texts.select(F.col("rid").alias("b"), F.col("text").alias("tb"))
    hot = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).cast("int").alias("ways")).filter("ways > 1")
    hot = stored(hot, "hubs")
    dealt = pairs.join(hot, "b", "left").withColumn("way", F.pmod(F.xxhash64("a"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    copies = right.join(hot, "b", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    return dealt.join(left.hint("merge"), "a").join(copies.hint("merge"), ["b", "way"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, both long, either long")


def links_in_buckets(placed: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(band, value, rep, hub, r: its component, far: distance to the hub) -> (a, b): links between components inside buckets.

    A bucket is dealt into blocks of bounded size, and two blocks meet in one task, with their full sets.  Pairs are compared there, in the first band that
    they share, as long as their components are still apart; only links that join two of them are handed on."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, values, bounds in shingle_sets(batch.column(1), words):
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array([values[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["rep", "set"])

    reps = placed.select("rep").distinct()
    sets = texts.join(reps.select(F.col("rep").alias("rid")).hint("merge"), "rid", "left_semi").mapInArrow(packed, "rep long, set binary")
    sets = stored(sets.join(classes.select("rep", "bands"), "rep").withColumn("bytes", F.length("set")), "sets")
    members = placed.join(sets.select("rep", "bytes"), "rep")
    sizes = members.groupBy("band", "value").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"), F.sum("bytes").alias("all"))
    sizes = stored(sizes, "sizes")
    tasks = 1 + int(sizes.filter("blocks = 1").agg(F.sum("all")).first()[0] or 0) // BLOCK_BYTES
    met = placed.join(sizes.select("band", "value", "blocks"), ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
    bucket = F.xxhash64("band", "value")
    met = met.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(bucket, F.lit(tasks))).otherwise(bucket)).drop("blocks", "other")

    def compare(table: pa.Table) -> pa.Table:
        c = {k: table[k].to_numpy() for k in ("band", "value", "rep", "hub", "r", "far", "own", "one", "two")}
        bands = table["bands"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        raw = table["set"].to_pylist()
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        out_a, out_b = [], []
        order = np.lexsort((c["rep"], c["value"], c["band"]))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(c["value"][order]) != 0) | (np.diff(c["band"][order]) != 0)]))
        for x, y in zip(cut, [*cut[1:], len(order)], strict=True):
            rows = order[x:y]
            rows = rows[c["rep"][rows] != c["hub"][rows]]  # the hub has been compared with all
            across = c["one"][rows[:1]] != c["two"][rows[:1]]
            sets = {i: np.frombuffer(raw[i], np.uint64) for i in rows.tolist()}
            size = np.array([len(sets[i]) for i in rows.tolist()])
            for k, i in enumerate(rows.tolist()):
                rest, rest_size = rows[k + 1 :], size[k + 1 :]
                keep = (c["r"][rest] != c["r"][i]) & (100 * np.minimum(rest_size, size[k]) >= percent * np.maximum(rest_size, size[k]))
                keep &= ~(np.abs(c["far"][rest] - c["far"][i]) > 1 - percent / 100 + 1e-9)  # an unknown distance rules nothing out
                if across.all():
                    keep &= c["own"][rest] != c["own"][i]
                rest = rest[keep]
                rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == c["band"][i]] if len(rest) else rest
                for j in rest.tolist():
                    one, two = root(int(c["r"][i])), root(int(c["r"][j]))
                    if one == two:
                        continue
                    small, large = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int(np.count_nonzero(large[at] == small))
                    if 100 * both >= percent * (len(small) + len(large) - both):
                        above[max(one, two)] = min(one, two)
                        out_a.append(c["rep"][i])
                        out_b.append(c["rep"][j])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    grouped = met.join(sets.select("rep", "bands", "set"), "rep").groupBy("task", "one", "two")
    return stored(grouped.applyInArrow(compare, "a long, b long"), "more")


def roots_of(rows: DataFrame, words: int, percent: int, band_rows: int) -> DataFrame:
    """(rid unique, text) -> (rid, n_shingles, root): root is the smallest rid reachable by links."""
    signed = stored(signatures(rows.select("rid", "text"), words, band_rows), "signatures")
    classes = signed.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("rid").alias("rep"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")
    entries = classes.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    hubs = entries.groupBy("band", "value").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    hubs = hubs.select("band", "value", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = stored(entries.join(hubs, ["band", "value"]), "members")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    star = members.filter("rep <> hub").filter(fits("n", "hub_n")).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    star = stored(star, "star")
    texts = rows.select("rid", "text")

    def wanted(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
        return stored(texts.join(ids.hint("merge"), "rid", "left_semi"), "texts")

    checked = stored(verified(star, wanted(star), words), "checked")
    link = 100 * F.col("both") >= percent * F.col("either")
    edges = checked.filter(link).select("a", "b")
    roots = components(edges)
    root = lambda name, of: roots.select(F.col("id").alias(of), F.col("root").alias(name))
    placed = members.join(root("r", "rep"), "rep", "left").join(root("hr", "hub"), "hub", "left").withColumns({"r": F.coalesce("r", "rep"), "hr": F.coalesce("hr", "hub")})
    apart = placed.filter("r <> hr").select("band", "value").distinct()
    far = checked.select(F.col("a").alias("rep"), F.col("b").alias("hub"), (1 - F.col("both") / F.col("either")).alias("far"))
    placed = placed.join(apart, ["band", "value"], "left_semi").join(far, ["rep", "hub"], "left")
    placed = stored(placed.select("band", "value", "rep", "hub", "r", "far"), "placed")
    if placed.limit(1).collect():
        roots = components(edges.union(links_in_buckets(placed, classes, texts, words, percent)))
    named = signed.select("rid", "n", "d1", "d2").join(classes.select("d1", "d2", "n", "rep"), ["d1", "d2", "n"], "left")
    return named.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "rid").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, band_rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, n_shingles, component_id, kept): links are 100 * intersection >= percent * union.

    component_id is the smallest id reachable; of rows with equal ids exactly one is kept."""
    bounded_batches(docs.sparkSession)
    rows, plain = unique_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    named = roots_of(rows.select("rid", "text"), words, percent, band_rows)
    kept = (F.col("rid") == F.col("root")).alias("kept")
    if plain:
        return named.select(F.col("rid").alias(id_col), "n_shingles", F.col("root").alias("component_id"), kept)
    names = rows.select("rid", F.col("doc_id").alias(id_col))
    named = named.join(names, "rid").join(names.select(F.col("rid").alias("root"), F.col(id_col).alias("component_id")), "root")
    return named.select(id_col, "n_shingles", "component_id", kept)


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, band_rows: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first document of each component; all columns stay."""
    bounded_batches(docs.sparkSession)
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    rows, _ = unique_ids(whole, "doc_id", "text")
    first = roots_of(rows.select("rid", "text"), words, percent, band_rows).filter("rid = root").select("rid")
    return rows.join(first, "rid", "left_semi").select("row.*")
