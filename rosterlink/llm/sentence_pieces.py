"""SentencePiece encoding and decoding of whole texts, with the source bytes of every piece.

A text is normalised through the model's compiled character map: at each place the longest key of the map is replaced, other characters stand.
Every normalised byte keeps the place of the source unit that it comes from, through the rules for white space too, so each piece is
projected to a span of bytes of the text as it was.  A character written as several byte pieces belongs to the last of them; the others have empty spans.

Merges never cross a place between two characters whose classes are neighbours in no piece of the vocabulary.  The normalised text is cut there, and each distinct
segment is encoded once; what has not been asked for lately is forgotten.

Null texts count as empty; an empty text has no pieces and decodes to an empty text.  Rows are independent: repeated rows, ties and null ids are
kept.  Other columns are dropped, so their names cannot clash.  Models that are not BPE with byte fallback, or have symbols of the user or white space as a
suffix, are refused."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bounded_batches
from .hashing import raw_bytes, some_at_a_time
from .tokens import Generations, gathered

MEMO = 80_000
SPACE = "▁".encode()
NORMAL, UNKNOWN, CONTROL, OWN, BYTE = 1, 2, 3, 4, 6  # kinds of pieces in the model's file
BPE = 2
# Classes of characters by their first byte: letters, digits, marks and controls of ASCII, then all else; the space symbol is a class of its own.
CLASSES = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if b < 33 or b == 127 else 3 for b in range(128)] + [4] * 128, np.uint8)
SYMBOL = 5


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, message[at : at + n]
        at += n


def symbols(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the starts of characters are space symbols."""
    some = np.flatnonzero((data[starts] == SPACE[0]) & (starts + 2 < len(data)))
    return some[(data[starts[some] + 1] == SPACE[1]) & (data[starts[some] + 2] == SPACE[2])]


class CharacterMap:
    """A compiled character map: a double array that holds the keys, and the texts that stand for them."""

    def __init__(self, compiled: bytes) -> None:
        n = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + n], "<u4").astype(np.int64)
        self.texts = np.frombuffer(compiled[4 + n :], np.uint8)
        ends = np.flatnonzero(self.texts == 0)
        self.end_of = lambda first: ends[np.searchsorted(ends, first)] if len(ends) else first

    @staticmethod
    def away(units: np.ndarray) -> np.ndarray:
        return (units >> 10) << ((units & (1 << 9)) >> 6)

    def longest(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the length of the longest key there, within its text's end (0: none), and where its text is.  All places go down the array together."""
        size, text = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.units):
            return size, text
        live, node, depth = np.arange(len(starts)), np.full(len(starts), int(self.away(self.units[0]))), 0
        while len(live):
            inside = starts[live] + depth < ends[live]
            live, node = live[inside], node[inside]
            byte = data[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            node_ok = node < len(self.units)
            live, node, byte = live[node_ok], node[node_ok], byte[node_ok]
            unit = self.units[node]
            same = (unit & ((1 << 31) | 0xFF)) == byte
            live, node, unit = live[same], node[same], unit[same]
            node = node ^ self.away(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            size[live[leaf]] = depth
            text[live[leaf]] = self.units[node[leaf]] & ((1 << 31) - 1)
        return size, text


class Normalised:
    """The normalised bytes of several texts in a row; bounds of each; and for each byte, and each end, the source byte (from its text's start)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, source: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.bounds, self.source, self.ends = data, bounds, source, ends


class Model:
    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        said: dict[int, list] = {}
        for k, x in fields(raw):
            said.setdefault(k, []).append(x)
        trained, rules = (dict(fields(b"".join(said[k]))) for k in (2, 3))  # parts of a message add up
        pieces = [dict(fields(x)) for x in said[1]]
        self.pieces, self.kinds = [x.get(1, b"") for x in pieces], np.array([x.get(3, NORMAL) for x in pieces])
        if trained.get(3, 1) != BPE or not trained.get(35, 0) or trained.get(24, 0) or (self.kinds == OWN).any():
            raise ValueError(f"{path}: not a BPE model with byte fallback, or with symbols of the user, or with white space as a suffix")
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        plain = b"\x0a\x08identity\x12\x00\x18\x00\x20\x00\x28\x00"  # what comes last counts: normalised text is taken as it is
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw + b"\x1a" + bytes([len(plain)]) + plain)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.sizes = np.array([1 if kind == BYTE else len(x) for x, kind in zip(self.pieces, self.kinds, strict=True)], np.int64)
        self.segments = Generations(MEMO)
        meet = np.zeros((6, 6), bool)
        for x, kind in zip(self.pieces, self.kinds, strict=True):
            if kind not in (UNKNOWN, CONTROL, BYTE):
                c = [SYMBOL if ch == SPACE.decode() else int(CLASSES[ch.encode()[0]]) for ch in x.decode()]
                meet[c[:-1], c[1:]] = True
        self.cut = ~meet
        shown = [b"" if kind == CONTROL else bytes([int(x[3:5], 16)]) if kind == BYTE else x.replace(SPACE, b" ") for x, kind in zip(self.pieces, self.kinds, strict=True)]
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.leads = np.array([kind == NORMAL and x.startswith(SPACE) and self.prefix and not self.squeeze for x, kind in zip(self.pieces, self.kinds, strict=True)])

    def normalise(self, data: np.ndarray, bounds: np.ndarray) -> Normalised:
        owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        first = np.flatnonzero((data & 0xC0) != 0x80)  # starts of characters
        size, text = self.map.longest(data, first, bounds[1:][owner[first]])
        keyed = np.flatnonzero(size)
        width = np.diff(np.append(first, len(data)))
        if len(keyed):
            hidden, upto = np.zeros(len(first), bool), -1
            for k in keyed[size[keyed] > width[keyed]]:  # keys of several characters hide what starts inside them
                if first[k] < upto:
                    size[k] = 0
                    continue
                upto = first[k] + size[k]
                hidden[k + 1 : np.searchsorted(first, upto)] = True
            first, size, text, width = (x[~hidden] for x in (first, size, text, width))
        from_map = size > 0
        if from_map.any():
            length = np.where(from_map, self.map.end_of(text) - text, width)
            out, _ = gathered(np.concatenate([data, self.map.texts]), np.where(from_map, len(data) + text, first), length, np.arange(len(first)))
        else:
            out, length = data, width
        source, texts = np.repeat((first - bounds[:-1][owner[first]]).astype(np.int32), length), np.repeat(owner[first], length)
        unit = np.repeat(np.arange(len(first)), length) if self.squeeze else None
        last = np.diff(bounds).copy()  # how much of each text is used up at its end
        if self.squeeze:
            out, source, texts = self.squeezed(out, source, texts, unit)
        if self.prefix:
            own = np.flatnonzero(np.diff(texts, prepend=-1))  # the first byte of each text that is not empty
            out, source, texts = np.insert(out, own, 32), np.insert(source, own, source[own]), np.insert(texts, own, texts[own])
        if self.escape:
            space = out == 32
            times = np.where(space, 3, 1)
            at = np.cumsum(times) - times
            spread = np.repeat(out, times)
            for k, byte in enumerate(SPACE):
                spread[at[space] + k] = byte
            out, source, texts = spread, np.repeat(source, times), np.repeat(texts, times)
        if self.squeeze:
            out, source, texts = self.without_tail(out, source, texts, last)
        return Normalised(out, np.searchsorted(texts, np.arange(len(bounds))), source, last)

    @staticmethod
    def squeezed(out: np.ndarray, source: np.ndarray, texts: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without spaces in front, and one for several: those go that head a unit where the unit before ends with one."""
        if not len(out):
            return out, source, texts
        space = out == 32
        starts = np.diff(unit, prepend=-1) != 0
        began = np.maximum.accumulate(np.where(starts, np.arange(len(out)), 0))
        solid = np.cumsum(~space)
        heads = space & (solid - np.where(began > 0, solid[began - 1], 0) == 0)
        fresh = np.diff(texts, prepend=-1) != 0
        before = np.where(fresh[began], True, space[began - 1])  # the start of a text counts as a space
        keep = ~(heads & before)
        return out[keep], source[keep], texts[keep]

    def without_tail(self, out: np.ndarray, source: np.ndarray, texts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without the space symbols at the ends of texts; last is set to where the first of those came from."""
        solid = out != 32
        if self.escape:
            solid = np.ones(len(out), bool)
            at = symbols(out, np.arange(len(out)))
            for k in range(3):
                solid[at + k] = False
        end, solid = np.full(len(last), -1), np.flatnonzero(solid)
        np.maximum.at(end, texts[solid], solid)
        keep = np.arange(len(out)) <= end[texts]
        gone = np.flatnonzero(~keep)
        if len(gone):
            lead = gone[np.r_[True, texts[gone[1:]] != texts[gone[:-1]]]]
            last[texts[lead]] = source[lead]
        return out[keep], source[keep], texts[keep]

    def segment_starts(self, text: Normalised) -> np.ndarray:
        """Where the normalised bytes may be cut, the texts' own starts included."""
        data = text.data
        first = np.flatnonzero((data & 0xC0) != 0x80)
        kind = CLASSES[data[first]]
        kind[symbols(data, first)] = SYMBOL
        cut = np.zeros(len(data), bool)
        cut[first[1:]] = self.cut[kind[:-1], kind[1:]]
        cut[text.bounds[:-1][np.diff(text.bounds) > 0]] = True
        return np.flatnonzero(cut)

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        return [array("i", x).tobytes() for x in self.library.encode(segments, out_type=int, num_threads=1)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts in a row, int32; where each text's ids start (and the end); and the first and the last source byte of each piece."""
        norm = self.normalise(*raw_bytes(texts))
        starts = self.segment_starts(norm)
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        segments = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(norm.data))), pa.py_buffer(norm.data)).dictionary_encode()
        known = self.segments.get_all(segments.dictionary.to_pylist(), self.encode_segments)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, ends = gathered(np.frombuffer(b"".join(known), np.int32), np.cumsum(size) - size, size, segments.indices.to_numpy())
        bounds = np.append(ends[:-1], len(ids))[np.searchsorted(np.append(starts, len(norm.data)), norm.bounds)]
        after = np.cumsum(self.sizes[ids])
        closing = np.repeat(norm.ends, np.diff(bounds))
        upto = np.append(norm.source, 0)[after]
        upto[bounds[1:][np.diff(bounds) > 0] - 1] = closing[bounds[1:][np.diff(bounds) > 0] - 1]
        return ids, bounds, norm.source[after - self.sizes[ids]].astype(np.int32), upto.astype(np.int32)

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids: the bytes of all pieces gathered at once.  Lists that need more (bytes that are no text, pieces that stand for nothing, a first piece
        without a space) go through the library."""
        offsets = lists.offsets.to_numpy()
        ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        null, at = lists.is_null().to_numpy(zero_copy_only=False), offsets - offsets[0]
        data, ends = gathered(self.shown, np.cumsum(self.shown_size) - self.shown_size, self.shown_size, ids)
        full = np.flatnonzero(np.diff(at))
        odd = np.zeros(len(lists), bool)
        odd[full] = ~self.leads[ids[at[full]]]
        strange = np.isin(self.kinds[ids], (UNKNOWN, CONTROL))
        odd[np.repeat(np.arange(len(lists)), np.diff(at))[strange]] = True
        begin, end = ends[at[:-1]].copy(), ends[at[1:]]
        begin[full] += ~odd[full]  # the space in front
        raw = data.tobytes()
        out = []
        for k in range(len(lists)):
            if null[k]:
                out.append(None)
                continue
            if not odd[k]:
                try:
                    out.append(raw[begin[k] : end[k]].decode())
                    continue
                except UnicodeDecodeError:
                    pass
            out.append(self.whole.decode(ids[at[k] : at[k + 1]].tolist()))
        return pa.array(out, pa.string())


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    """One for each Python worker and file."""
    return Model(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id_col, ids, starts, ends): the ids of every whole text, without begin or end ids, and the span of source bytes (UTF-8) of each."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for a, b in some_at_a_time(raw_bytes(texts)[1]):
                ids, bounds, starts, ends = own.encode(texts.slice(a, b - a))
                bounds = pa.array(bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["id", "ids", "starts", "ends"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text that the ids of each row stand for.  Null ids: a null text.  A column already called `to` is replaced."""
    bounded_batches(rows.sparkSession)
    kept = rows.drop(to)
    names, at = [*kept.columns, to], kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, own.decode(batch.column(at))], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(to, StringType())]))
