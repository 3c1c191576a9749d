"""Phrases of words that stand together more often than their parts would by chance, by language.

Documents are dealt into shards, each of one language and of bounded size.  A shard's words have position bitmaps, of which only the blocks that are not empty are kept; a piece's
end is a position without a word, so nothing reaches over it.  A phrase's bitmap holds where it ends: moved on by one place and intersected with a
word's bitmap it is that of the longer phrase, and its ones are the occurrences.  Phrases are extended depth-first, in runs of prefixes.

A phrase is only as frequent as its rarest part.  So words are counted first and rare ones become ends of pieces; then pairs, summed over all shards; each shard learns
which of its own pairs are frequent, and goes down to longer phrases along these alone.  Sums are made in groups of equal hash bits: a shard gives a group one row, however
frequent a phrase is.  All frequent words, pairs and phrases stay tables.

Null texts count as empty, a null language is `und`.  Repeated rows count as often as they are there, ids are not read, and other columns neither.  Equal scores are ordered by
count, then by the phrase's bytes.  A document is never cut, so a shard is as large as its longest document at least."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bounded_batches, stored
from .hashing import Spans, mix, raw_bytes, some_at_a_time

SHARD_TOKENS = 1 << 20
GROUP_TOKENS, LEAST_GROUPS = 1 << 20, 64
CHUNK = 1 << 17
LONGEST = 5
WIDTH = 8  # positions in a block
_lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ends = np.zeros(256, bool)
_ends[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_blank = _ends.copy()
_blank[[0x20, 0x09]] = True


def packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, compressed: the first bytes of all, then the second ones, as the upper bytes of most are alike."""
    flat = np.ascontiguousarray(values).ravel()
    return pa.compress(flat.view(np.uint8).reshape(len(flat), -1).T.tobytes(), "zstd", asbytes=True) if len(flat) else b""


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T).view(kind).ravel()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and whether each is the first of its piece."""
    data, bounds = raw_bytes(texts)
    data = _lower[data]
    inside = ~_blank[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # a text ends and the next begins, both inside a word
    starts, ends = np.sort(np.r_[np.flatnonzero(edge == 1), cut]), np.sort(np.r_[np.flatnonzero(edge == -1), cut])
    pieces = np.r_[0, np.cumsum(_ends[data])]
    piece = pieces[starts] + np.searchsorted(bounds, starts, "right")
    offsets = np.append(np.c_[starts, ends].ravel(), ends[-1] if len(ends) else 0).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(offsets), pa.py_buffer(data))  # words, and what lies between them
    return held.take(pa.array(np.arange(0, 2 * len(starts), 2))), np.diff(piece, prepend=-1) != 0


class Shard:
    """Words of one language, until there are enough of them."""

    def __init__(self) -> None:
        self.words: list[pa.Array] = []
        self.firsts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: pa.Array, firsts: np.ndarray) -> None:
        self.words.append(words)
        self.firsts.append(firsts)
        self.size += len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        coded = pa.concat_arrays(self.words).dictionary_encode()
        codes, first = coded.indices.to_numpy(), np.concatenate(self.firsts)
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        at = np.arange(len(codes)) + np.cumsum(first)  # each piece begins after a place without a word
        placed = np.zeros(len(codes) + int(first.sum()) + 1, np.int32)
        placed[at] = codes + 1
        words = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), coded.dictionary.cast(pa.string()))
        times = pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts, pa.int64()))
        columns = [pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([len(codes)], pa.int64()), words, times, pa.array([len(placed)], pa.int64()), pa.array([packed(placed)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "lang", "n", "words", "times", "size", "codes"])


def shards_of(docs: DataFrame, text_col: str, lang_col: str, most: int) -> DataFrame:
    """(shard, lang, n, words, times, size, codes): a row for each shard; codes are places of words from 1 on, 0 where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = {}, TaskContext.get().partitionId() << 32
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, code))
                for a, b in some_at_a_time(raw_bytes(texts)[1]):
                    words, firsts = words_of(texts.slice(a, b - a))
                    if len(words):
                        own.setdefault(lang, Shard()).add(words, firsts)
                    if lang in own and own[lang].size >= most:
                        yield own.pop(lang).row(number, lang)
                        number += 1
        for lang, shard in own.items():
            yield shard.row(number, lang)
            number += 1

    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "shard long, lang string, n long, words array<string>, times array<long>, size long, codes binary")


def frequent_words(shards: DataFrame, least: int, groups: int) -> DataFrame:
    """(shard, lang, words, times) -> (shard, lang, m, codes, ids, words, totals, numbers): which of a shard's words are frequent and their numbers, a row for each group; and for no shard, the
    words of the group themselves.  Numbers are from 1 on, each that of the word in its group times the number of groups, so they stay small."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(2).slice(i, 1).flatten()
                times = batch.column(3).slice(i, 1).flatten().to_numpy()
                data, bounds = raw_bytes(words)
                hashes = np.concatenate([Spans(data[bounds[a] : bounds[b]]).hashes(bounds[a:b] - bounds[a], bounds[a + 1 : b + 1] - bounds[a]) for a, b in some_at_a_time(bounds)])
                rows = []
                for k, (code, n) in by_group([np.arange(len(words)), times], groups, hashes):
                    own = words.take(pa.array(code))
                    text, ends = raw_bytes(own)
                    rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), k, len(code), len(text), packed(text), packed(np.diff(ends).astype(np.int32)), packed(code.astype(np.int32)), packed(n)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["shard", "lang", "part", "m", "bytes", "text", "sizes", "codes", "counts"])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        part, before, out = key[0].as_py(), 0, []
        langs = table["lang"].to_pylist()
        for lang in dict.fromkeys(langs):
            rows = table.filter(pa.array([x == lang for x in langs])).to_pylist()
            sizes = [r["m"] for r in rows]
            words = pa.concat_arrays([strings(unpacked(r["text"], r["bytes"], np.uint8), unpacked(r["sizes"], r["m"], np.int32)) for r in rows]).dictionary_encode()
            place, totals = words.indices.to_numpy(), np.zeros(len(words.dictionary), np.int64)
            np.add.at(totals, place, np.concatenate([unpacked(r["counts"], r["m"], np.int64) for r in rows]))
            good = np.flatnonzero(totals >= least)
            number = np.zeros(len(totals), np.int64)
            number[good] = (np.arange(len(good)) + before) * groups + part + 1
            before += len(good)
            if before * groups >= 1 << 31:
                raise ValueError("too many frequent words for numbers of 31 bits")
            if len(good):
                out.append((None, lang, len(good), None, None, words.dictionary.take(pa.array(good)).to_pylist(), totals[good].tolist(), number[good].tolist()))
            for r, a in zip(rows, np.cumsum(sizes) - sizes, strict=True):
                ids = number[place[a : a + r["m"]]]
                own = np.flatnonzero(ids)
                if len(own):
                    out.append((r["shard"], lang, len(own), packed(unpacked(r["codes"], r["m"], np.int32)[own]), packed(ids[own].astype(np.int32)), None, None, None))
        columns = list(zip(*out, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()))
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("shard", "lang", "m", "codes", "ids", "words", "totals", "numbers"), columns, kinds, strict=True)})

    rows = shards.select("shard", "lang", "words", "times").mapInArrow(counted, "shard long, lang string, part long, m long, bytes long, text binary, sizes binary, codes binary, counts binary")
    return dealt(rows, groups).groupBy("part").applyInArrow(summed, "shard long, lang string, m long, codes binary, ids binary, words array<string>, totals array<long>, numbers array<int>")


def strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes, dtype=np.int64)]), pa.py_buffer(data))


def runs_of(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard and the numbers of its frequent words -> its places with numbers; rare words are ends of pieces, and words without a neighbour go."""
    size = left["size"][0].as_py()
    codes = unpacked(left["codes"][0].as_py(), size, np.int32)
    ids = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    for r in right.to_pylist():
        ids[unpacked(r["codes"], r["m"], np.int32) + 1] = unpacked(r["ids"], r["m"], np.int32)
    placed = ids[codes]
    full = placed > 0
    beside = np.zeros(len(full), bool)
    beside[1:] |= full[:-1]
    beside[:-1] |= full[1:]
    placed = np.where(beside, placed, 0)
    placed = placed[(placed > 0) | np.r_[True, placed[:-1] > 0]]
    return pa.table({"shard": left["shard"], "size": pa.array([len(placed)], pa.int64()), "ids": pa.array([packed(placed)], pa.binary())})


class Bitmaps:
    """The position bitmaps of a shard's words: blocks of WIDTH places that are not empty, by word and by block."""

    def __init__(self, placed: np.ndarray) -> None:
        at = np.flatnonzero(placed)
        self.ids, word = np.unique(placed[at], return_inverse=True)
        order = np.argsort(word, kind="stable")
        self.word, self.block, self.bits = merged(word[order], at[order] // WIDTH, (1 << (at[order] % WIDTH)).astype(np.uint8))
        self.by_block = np.argsort(self.block, kind="stable")
        self.first = np.searchsorted(self.block[self.by_block], np.arange(len(placed) // WIDTH + 3))

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray, allowed) -> tuple[np.ndarray, ...]:
        """Bitmaps of phrases (an entry for each block, by phrase), each moved on by one place and intersected with the bitmap of every word that is there.

        Gives the phrase, the word and the number of ones of each pair that is left, and for each of its blocks the pair, the block and the bits; allowed(phrase, word) drops pairs."""
        over = bits >> (WIDTH - 1)
        more = np.flatnonzero(over)
        on = np.r_[bits << 1, over[more]]
        phrase, block = np.r_[phrase, phrase[more]], np.r_[block, block[more] + 1]
        some = np.flatnonzero(on)
        phrase, block, on = phrase[some], block[some], on[some]
        n = self.first[block + 1] - self.first[block]
        entry = np.repeat(np.arange(len(block)), n)
        place = np.arange(len(entry)) + np.repeat(self.first[block] - (np.cumsum(n) - n), n)
        there = self.by_block[place]
        both = on[entry] & self.bits[there]
        hit = np.flatnonzero(both)
        phrase, word, block, both = phrase[entry[hit]], self.word[there[hit]], block[entry[hit]], both[hit]
        if allowed is not None:
            good = allowed(phrase, word)
            phrase, word, block, both = phrase[good], word[good], block[good], both[good]
        key = phrase * len(self.ids) + word
        order = np.lexsort((block, key))
        key, block, both = merged(key[order], block[order], both[order])
        fresh = np.diff(key, prepend=-1) != 0
        pair = np.cumsum(fresh) - 1
        ones = np.bincount(pair, np.bitwise_count(both), minlength=int(fresh.sum())).astype(np.int64)
        return key[fresh] // len(self.ids), key[fresh] % len(self.ids), ones, pair, block, both


def merged(key: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each key and block, in order."""
    if not len(key):
        return key, block, bits
    fresh = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    return key[fresh], block[fresh], np.bitwise_or.reduceat(bits, fresh)


def chunks(phrase: np.ndarray) -> Iterator[slice]:
    """Runs of whole phrases of about CHUNK entries."""
    edges = np.r_[np.flatnonzero(np.diff(phrase)) + 1, len(phrase)] if len(phrase) else np.empty(0, np.int64)
    a = 0
    while a < len(phrase):
        b = int(edges[max(np.searchsorted(edges, a + CHUNK, "right") - 1, np.searchsorted(edges, a, "right"))])
        yield slice(a, b)
        a = b


def pairs_in(maps: Bitmaps) -> tuple[np.ndarray, np.ndarray]:
    """Keys (two numbers of words) of all pairs of the shard, ascending, and their counts."""
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ids = maps.ids.astype(np.int64)
    for part in chunks(maps.word):
        first, second, ones, *_ = maps.extended(maps.word[part], maps.block[part], maps.bits[part], None)
        keys.append(ids[first] << 32 | ids[second])
        counts.append(ones)
    return np.concatenate(keys), np.concatenate(counts)


def longer_in(maps: Bitmaps, pairs: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of three words or more whose pairs are all among those given (ascending keys): numbers of words (0: none), and counts."""
    ids, found, counts = maps.ids.astype(np.int64), [np.empty((0, longest), np.int32)], [np.empty(0, np.int64)]

    def known(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = ids[first] << 32 | ids[second]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return pairs[at] == key

    def down(words: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> None:
        for part in chunks(phrase):
            base = phrase[part.start]
            own = words[base : phrase[part.stop - 1] + 1]
            before, word, ones, pair, blocks, both = maps.extended(phrase[part] - base, block[part], bits[part], lambda p, w: known(own[p, -1], w))  # noqa: B023
            if not len(word):
                continue
            grown = np.c_[own[before], word]
            if grown.shape[1] > 2:
                row = np.zeros((len(grown), longest), np.int32)
                row[:, : grown.shape[1]] = ids[grown]
                found.append(row)
                counts.append(ones)
            if grown.shape[1] < longest:
                down(grown, pair, blocks, both)

    if len(pairs) and longest > 2:
        down(np.arange(len(ids))[:, None], maps.word, maps.block, maps.bits)
    return np.concatenate(found), np.concatenate(counts)


def bits_of(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = mix(out * np.uint64(3) + x.astype(np.uint64))
    return out


def by_group(columns: list[np.ndarray], groups: int, hashes: np.ndarray | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows dealt by the upper bits of their hash, ascending in each group; the last column is no part of the key."""
    group = ((bits_of(*columns[:-1]) if hashes is None else hashes) >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    order = np.lexsort((*reversed(columns[:-1]), group))
    edges = np.searchsorted(group[order], np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(edges)):
        rows = order[edges[k] : edges[k + 1]]
        yield int(k), [x[rows] for x in columns]


def frequent_pairs(runs: DataFrame, least: int, groups: int) -> DataFrame:
    """(shard, size, ids) -> (shard, m, keys, totals): the frequent pairs of each shard with their sums over all shards, a row for each group; and for no shard, all of the group."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, size, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "size", "ids")), strict=True):
                keys, counts = pairs_in(Bitmaps(unpacked(ids, size, np.int32)))
                rows = [(shard, k, len(key), packed(np.diff(key, prepend=0)), packed(n)) for k, (key, n) in by_group([keys, counts], groups)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["shard", "part", "m", "keys", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        sizes = table["m"].to_pylist()
        keys = [np.cumsum(unpacked(x, n, np.int64)) for x, n in zip(table["keys"].to_pylist(), sizes, strict=True)]
        counts = np.concatenate([unpacked(x, n, np.int64) for x, n in zip(table["counts"].to_pylist(), sizes, strict=True)])
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(known), np.int64)
        np.add.at(totals, place, counts)
        rows = []
        for shard, a, n in zip([None, *table["shard"].to_pylist()], [0, *(np.cumsum(sizes) - sizes)], [0, *sizes], strict=True):
            own = np.arange(len(known)) if shard is None else place[a : a + n]
            own = own[totals[own] >= least]
            if len(own):
                rows.append((shard, len(own), packed(known[own]), packed(totals[own])))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("shard", "m", "keys", "totals"), columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    rows = runs.mapInArrow(counted, "shard long, part long, m long, keys binary, counts binary")
    return dealt(rows, groups).groupBy("part").applyInArrow(summed, "shard long, m long, keys binary, totals binary")


def dealt(rows: DataFrame, groups: int) -> DataFrame:
    return rows.repartition(max(groups // 4, rows.sparkSession.sparkContext.defaultParallelism), "part")


def frequent_longer(runs: DataFrame, pairs: DataFrame, least: int, groups: int, longest: int) -> DataFrame:
    """(w array<int>, f): frequent phrases of three words or more, from the shards and their frequent pairs."""
    half = -(-longest // 2)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if left.num_rows and right.num_rows:
            own = np.sort(np.concatenate([unpacked(x, n, np.int64) for x, n in zip(right["keys"].to_pylist(), right["m"].to_pylist(), strict=True)]))
            found, counts = longer_in(Bitmaps(unpacked(left["ids"][0].as_py(), left["size"][0].as_py(), np.int32)), own, longest)
            wide = np.zeros((len(found), 2 * half), np.int64)
            wide[:, :longest] = found
            columns = [wide[:, k] << 32 | wide[:, k + 1] for k in range(0, 2 * half, 2)]
            rows = [(k, len(x[0]), packed(np.stack(x))) for k, x in by_group([*columns, counts], groups)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("part", "m", "rows"), columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    def summed(table: pa.Table) -> pa.Table:
        all_of = np.concatenate([unpacked(x, n * (half + 1), np.int64).reshape(half + 1, n) for x, n in zip(table["rows"].to_pylist(), table["m"].to_pylist(), strict=True)], axis=1)
        all_of = all_of[:, np.lexsort(all_of[:-1][::-1])]
        fresh = np.flatnonzero(np.r_[True, (all_of[:-1, 1:] != all_of[:-1, :-1]).any(axis=0)])
        totals = np.add.reduceat(all_of[-1], fresh)
        keys = all_of[:-1, fresh[totals >= least]]
        words = np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1).reshape(2 * half, -1).T[:, :longest]
        size = (words > 0).sum(axis=1)
        flat = words[words > 0].astype(np.int32)
        return pa.table({"w": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(flat)), "f": pa.array(totals[totals >= least])})

    met = runs.groupBy("shard").cogroup(pairs.filter("shard is not null").groupBy("shard")).applyInArrow(counted, "part long, m long, rows binary")
    return dealt(met, groups).groupBy("part").applyInArrow(summed, "w array<int>, f long")


def pairs_table(pairs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, keys, totals in zip(*(batch.column(c).to_pylist() for c in ("m", "keys", "totals")), strict=True):
                key = unpacked(keys, m, np.int64)
                w = np.stack([key >> 32, key & 0xFFFFFFFF], axis=1).astype(np.int32).ravel()
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * m + 1, 2), pa.int32()), pa.array(w)), pa.array(unpacked(totals, m, np.int64))], names=["w", "f"])

    return pairs.filter("shard is null").mapInArrow(rows, "w array<int>, f long")


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", shard_tokens: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, id), frequent phrases of all lengths (w array<int>, f), and the number of all words of each language (lang, n)."""
    bounded_batches(docs.sparkSession)
    shards = stored(shards_of(docs, text_col, lang_col, shard_tokens), "shards")
    sizes = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    tokens = shards.agg(F.sum("n")).first()[0] or 0
    groups = LEAST_GROUPS
    while groups * GROUP_TOKENS < tokens:
        groups *= 2
    found = stored(frequent_words(shards, least, groups), "words")
    words = found.filter("shard is null").select("lang", F.explode(F.arrays_zip("words", "totals", "numbers")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.totals").alias("f"), F.col("x.numbers").alias("id"))
    own = found.filter("shard is not null").select("shard", "m", "codes", "ids")
    runs = shards.select("shard", "size", "codes").groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(runs_of, "shard long, size long, ids binary")
    runs = stored(runs, "runs")
    pairs = stored(frequent_pairs(runs, least, groups), "pairs")
    longer = frequent_longer(runs, pairs, least, groups, longest)
    phrases = words.select(F.array("id").alias("w"), "f").unionByName(pairs_table(pairs)).unionByName(longer)
    return words, stored(phrases, "phrases"), sizes


def collocations(docs: DataFrame, least: int = 100, longest: int = LONGEST, most: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs -> (lang, rank, phrase, a, l, r, n, score): the `most` best phrases of each language.

    Of phrases of 2 to `longest` words that occur `least` times or more: a occurrences among n words, cut where floor(1000 * a * n / (l * r)) is lowest (the first such place), l and r
    being the occurrences of the two parts.  Phrases that occur nowhere but inside a longer one are left out."""
    words, phrases, sizes = frequent_phrases(docs, least, longest, text_col, lang_col, shard_tokens)
    several = phrases.filter(F.size("w") > 1)
    size = F.size("w")
    cuts = several.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("w", "a", "k", F.slice("w", 1, F.col("k")).alias("lw"), F.slice("w", F.col("k") + 1, size - F.col("k")).alias("rw"))
    cuts = cuts.join(phrases.select(F.col("w").alias("lw"), F.col("f").alias("l")), "lw").join(phrases.select(F.col("w").alias("rw"), F.col("f").alias("r")), "rw")
    longer = phrases.filter(F.size("w") > 2).select(F.explode(F.array(F.slice("w", 1, size - 1), F.slice("w", 2, size - 1))).alias("w"), F.col("f").alias("outer"))
    longer = longer.groupBy("w").agg(F.max("outer").alias("outer"))  # one word longer is enough: what is inside a longer phrase is inside each phrase between
    first = F.element_at("w", 1)
    langs = words.select(F.col("id").alias("first"), "lang").join(sizes, "lang")
    cuts = cuts.withColumn("first", first).join(langs, "first")
    whole = lambda x: x.cast("decimal(19,0)")
    cuts = cuts.withColumn("top", whole(F.col("a") * 1000) * whole(F.col("n"))).withColumn("under", whole(F.col("l")) * whole(F.col("r")))
    best = F.min(F.struct(F.expr("top div under").alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("w", "lang", "a", "n").agg(best)
    scored = scored.join(longer, "w", "left").filter(F.col("outer").isNull() | (F.col("outer") < F.col("a")))
    spelt = scored.select("w", F.posexplode("w").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("w").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    rows = scored.join(spelt, "w").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
