"""Words of a corpus that differ by one character, and the common form that each rare one stands for.

Words are counted over all documents.  Each word's polynomial hash without one character follows from the hashes of its prefixes and suffixes,
for all words and places at once.  Two words that differ by a replaced character agree without it at the same place; a word that
has one character more agrees, without it, with the whole shorter word.  Keys are dealt by their upper bits and sorted; what shares a key is compared
as strings.  A group of equal keys gives each of its words a count and its best partner, never a row for each pair; a group holds at most the
words that one character in one place can make (or, around a shorter word, one character in any place).

Null and empty texts have no words.  A null document id counts as an empty text in the draw below.  Repeated rows count as often as they
are there; ties of counts go to the smaller word in code-point order.  Other columns are not read."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .hashing import BASE, mix, powers, raw_bytes

GROUP_KEYS, LEAST_GROUPS = 1 << 15, 256
LONG = 128
VECTOR_BYTES = 64
ASIDE = 0xC3  # the first byte of U+00C0 to U+00FF in UTF-8, and of nothing else
SAME_PLACE, WHOLE, WITHOUT = 0, 1, 2
_letter = np.zeros(256, bool)
_letter[[b for b in range(128) if chr(b).isalpha()]] = True
_lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def steps() -> np.ndarray:
    """One byte's step of CRC-32, from its reversed polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_steps = steps()


def crc_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of spans of bytes, each carried on from the crc32 of what goes before it."""
    state = before ^ np.uint32(0xFFFFFFFF)
    live, depth = np.arange(len(starts)), 0
    while len(live) and depth < VECTOR_BYTES:
        live = live[sizes[live] > depth]
        s = state[live]
        state[live] = _steps[(s ^ data[starts[live] + depth]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        depth += 1
    out = state ^ np.uint32(0xFFFFFFFF)
    for k in live[sizes[live] > depth]:
        out[k] = zlib.crc32(data[starts[k] + depth : starts[k] + sizes[k]].tobytes(), int(out[k]))
    return out


def words_of(ids: pa.Array, texts: pa.Array, every: int | None, least: int) -> pa.Array:
    """The words of at least `least` characters, one for each run of letters; where `every` divides a run's draw, it has lost a character."""
    data, bounds = raw_bytes(texts)
    data = _lower[data]
    lead = data == ASIDE
    inside = _letter[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # a text ends and the next begins, both in letters
    starts, ends = np.sort(np.r_[np.flatnonzero(edge == 1), cut]), np.sort(np.r_[np.flatnonzero(edge == -1), cut])
    leads = np.r_[0, np.cumsum(lead)]
    sizes = ends - starts
    points = sizes - (leads[ends] - leads[starts])
    keep = points >= least
    starts, sizes, points, ends = starts[keep], sizes[keep], points[keep], ends[keep]
    drop = np.zeros(len(starts), bool)
    if every is not None:
        owner = np.searchsorted(bounds, starts, "right") - 1
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
        draw = crc_of(data, starts, sizes, prefix[owner])
        drop = draw % every == 0
    # words and what lies between them are one array of strings; every second one is a word
    held = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(np.append(np.c_[starts, ends].ravel(), ends[-1] if len(ends) else 0).astype(np.int64)), pa.py_buffer(data))
    words = held.take(pa.array(2 * np.flatnonzero(~drop)))
    if not drop.any():
        return words
    short = [w[:k] + w[k + 1 :] for w, k in zip(held.take(pa.array(2 * np.flatnonzero(drop))).to_pylist(), (draw[drop] % points[drop]).tolist(), strict=True)]
    return pa.concat_arrays([words, pa.array([w for w in short if len(w) >= least], pa.large_string())])


def word_counts(docs: DataFrame, every: int | None = 31, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (word, n): runs of `[A-Za-z]` and U+00C0 to U+00FF, only A-Z lower-cased, of `least` characters or more.

    `every` makes mistakes to be found: let h be crc32 of `<id>:<run>`; where `every` divides h, the run loses its character h % length.  None: no mistakes."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words_of(batch.column(0), pc.fill_null(batch.column(1), ""), every, least).dictionary_encode()
            n = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
            yield pa.RecordBatch.from_arrays([found.dictionary.cast(pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def points_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each word starts (and the end)."""
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32), np.r_[0, np.cumsum(sizes)]


def letter_hash(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(BASE))


def deletion_keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, word's place, kind, character's place): the hash of each word, and of each word without each character; once with the place
    mixed in, for words that have another character there, and once without it, for shorter words (one for each run of equal characters, as its deletions are equal)."""
    points, starts = points_of(words)
    size = np.diff(starts)
    owner = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(points)) - starts[owner]
    up, down = powers(int(size.max(initial=0)) + 1)
    letters = letter_hash(points)
    sums = np.r_[np.uint64(0), np.cumsum(letters * up[at])]  # prefix sums over all words; a word's own start is subtracted
    head, tail = sums[:-1] - sums[starts[owner]], sums[starts[owner + 1]] - sums[1:]
    without = head + tail * down[1] if len(points) else head  # what follows moves one place down
    whole = sums[starts[1:]] - sums[starts[:-1]]
    again = np.r_[False, (points[1:] == points[:-1]) & (at[1:] > 0)] if len(points) else np.zeros(0, bool)
    fresh = np.flatnonzero(~again)
    key = np.r_[mix(without * np.uint64(BASE) + at.astype(np.uint64) + np.uint64(1)), mix(whole.copy()), mix(without[fresh])]
    place = np.r_[owner, np.arange(len(words)), owner[fresh]]
    kind = np.r_[np.full(len(owner), SAME_PLACE), np.full(len(words), WHOLE), np.full(len(fresh), WITHOUT)].astype(np.int8)
    return key, place, kind, np.r_[at, np.zeros(len(words), np.int64), at[fresh]].astype(np.int32)


def partners(table: pa.Table) -> pa.Table:
    """Rows (key, kind, at, word, n) of one radix -> (word, n_near, best, best_n): a row for each word of each group that has a partner in it."""
    key, kind = table["key"].to_numpy(), table["kind"].to_numpy()
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.diff(key[order])) + 1
    starts, sizes = np.r_[0, edge][: len(order)], np.diff(np.r_[0, edge, len(order)])
    some = np.repeat(sizes > 1, sizes)
    rows = order[some]
    if not len(rows):
        return pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.string()), "best_n": pa.array([], pa.int64())})
    words = table["word"].take(pa.array(rows)).combine_chunks().to_pylist()
    kinds, at, n, keys = kind[rows].tolist(), table["at"].to_numpy()[rows].tolist(), table["n"].to_numpy()[rows].tolist(), key[rows].tolist()
    groups: dict[tuple, list[int]] = {}
    for i, (w, kd, a, k) in enumerate(zip(words, kinds, at, keys, strict=True)):
        cut = w if kd == WHOLE else w[:a] + w[a + 1 :]
        groups.setdefault((k, cut, a, True) if kd == SAME_PLACE else (k, cut), []).append(i)  # equal keys are not enough
    out: list[tuple] = []
    for found, members in groups.items():
        if len(members) < 2:
            continue
        if len(found) == 4:
            best = sorted(members, key=lambda i: (-n[i], words[i]))[:2]
            for i in members:
                other = best[1] if i == best[0] else best[0]
                out.append((words[i], len(members) - 1, words[other], n[other]))
            continue
        short = [i for i in members if kinds[i] == WHOLE]
        longer = [i for i in members if kinds[i] == WITHOUT]
        if short and longer:  # the shorter word is there once
            first = min(longer, key=lambda i: (-n[i], words[i]))
            out.append((words[short[0]], len(longer), words[first], n[first]))
            out += [(words[i], 1, words[short[0]], n[short[0]]) for i in longer]
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({"word": pa.array(columns[0], pa.string()), "n_near": pa.array(columns[1], pa.int64()), "best": pa.array(columns[2], pa.string()), "best_n": pa.array(columns[3], pa.int64())})


def near_words(words: DataFrame) -> DataFrame:
    """(wid, word, n), words and wid distinct -> (word, n_near, best, best_n): how many words differ by one character, and the most frequent of them (none: no row).

    A word has about twice as many keys as characters, and each carries the word.  Keys of LONG characters or more carry its number instead, and get the word only where another row
    has the same key, so very long words do not grow with their square."""
    bounded_batches(words.sparkSession)
    schema = "key long, kind byte, at int, wid long, word string, n long"

    def keyed(long: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, place, kind, at = deletion_keys(batch.column(1))
                left = pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False)[place] - (kind != WHOLE)
                rows = np.flatnonzero((left >= LONG) == long)
                for a in range(0, len(rows), 1 << 16):
                    some = rows[a : a + (1 << 16)]
                    own = batch.take(pa.array(place[some]))
                    word = pa.nulls(len(some), pa.string()) if long else own.column(1)
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(kind[some]), pa.array(at[some]), own.column(0), word, own.column(2)], names=["key", "kind", "at", "wid", "word", "n"])

        return run

    words = words.select("wid", "word", "n")
    rows = words.filter(F.length("word") <= LONG).mapInArrow(keyed(False), schema)
    bare = words.filter(F.length("word") >= LONG).mapInArrow(keyed(True), schema).drop("word")
    shared = bare.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    bare = bare.join(shared, "key").join(words.select("wid", "word"), "wid")
    total = words.agg(F.sum(2 * F.least(F.length("word"), F.lit(LONG)) + 1)).first()[0] or 0
    parts = LEAST_GROUPS
    while parts * GROUP_KEYS < total:
        parts *= 2
    rows = rows.unionByName(bare).withColumn("radix", F.shiftrightunsigned("key", 65 - parts.bit_length()))
    found = rows.repartition(max(parts // 4, words.sparkSession.sparkContext.defaultParallelism), "radix").groupBy("radix").applyInArrow(partners, "word string, n_near long, best string, best_n long")
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def variants(docs: DataFrame, every: int | None = 31, least: int = 7, twice: int = 2, times: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (word, form, root, n, n_near, form_n): words of at least `twice` occurrences.  A word's form is its most frequent near word, if that is at least
    `times` as frequent; its root is where forms lead to in the end, itself if it has none."""
    words = stored(word_counts(docs, every, least, id_col, text_col).filter(F.col("n") >= twice).withColumn("wid", F.monotonically_increasing_id()), "words")  # the numbers stay as they are
    near = near_words(words)
    rows = words.join(near.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left").drop("w")
    good = F.col("best_n") >= F.col("n") * times
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    moved = stored(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # counts grow `times` fold with each step and each round doubles the steps, so few rounds are enough
        further = moved.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = stored(moved.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        moved = stepped.select("word", "root")
        if not stepped.filter("on").limit(1).collect():
            break
    out = rows.join(moved, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
