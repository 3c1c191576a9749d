"""Suffix-array dedup: every byte covered by a string of `length` bytes that also starts earlier is removed.

The suffixes of all texts are dealt out by content, so that no suffix array has to hold them all and none is compared over the network:

1. Anchors.  Every window of `length` bytes has one anchor, the leftmost of its spans of `GRAM` bytes with the smallest hash.  Equal
   windows have equal anchors at the same place.  A run of windows with the same anchor, and the bytes it covers, are a block.  Of equal blocks met by one
   task only the first travels on; the others repeat it and are marked at once.
2. Blocks meet by the hash of their anchor.  A block whose anchor occurs nowhere else repeats nothing and is dropped.  Of equal blocks the first one stands
   for all; the others are marked.
3. The bytes of blocks that share an anchor but differ are fetched and dealt out by it.  Each task sorts their suffixes by the difference-cover
   algorithm (suffix_array) and compares adjacent prefixes of `length` bytes; of equal ones all but the first are marked.
   An anchor with very many different blocks is dealt out by single windows and their hash, so that no task gets all of it; should even that
   exceed a suffix array, the windows themselves are sorted, 8 bytes after the other.
4. Marks meet their document, are merged to spans, and cut out.

Blocks are compared by 128 bits (their anchor's and their own 64-bit hash).

Documents are ordered by their id, rows without one last, rows with equal ids by a hash of the text and then in any order; each is a document of its own.  Null texts count as
empty.  Texts shorter than `length` lose nothing.  Other columns are dropped, so their names cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, unique_ids
from .hashing import Spans, mix, raw_bytes, some_at_a_time
from .suffix_array import MOST, suffix_array

LENGTH = 100
GRAM = 32
RUNS_AT_ONCE = 600_000
BUCKET_BYTES = 24 << 20
HOT_BLOCKS = 4096
SEGMENT = 8 << 20
RUN = [("h", "<u8"), ("c", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("n", "<i4")]
MARK = [("rid", "<i8"), ("s", "<i4"), ("n", "<i4")]
ASK = [("h", "<u8"), ("s", "<i4"), ("n", "<i4"), ("ways", "<i4")]
BLOCK = [("h", "<u8"), ("rid", "<i8"), ("s", "<i4"), ("n", "<i4")]


def packed(columns: dict[str, np.ndarray], kinds: list[tuple[str, str]], at: np.ndarray | slice) -> bytes:
    """The columns one behind the other: those that hardly vary compress well so."""
    return b"".join(columns[k].astype(t, copy=False)[at].tobytes() for k, t in kinds)


def unpacked(parts: list[bytes], kinds: list[tuple[str, str]]) -> dict[str, np.ndarray]:
    size = sum(np.dtype(t).itemsize for _, t in kinds)
    out: dict[str, list[np.ndarray]] = {k: [np.empty(0, t)] for k, t in kinds}
    for raw in parts:
        n, at = len(raw) // size, 0
        for k, t in kinds:
            out[k].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    return {k: np.concatenate(v) for k, v in out.items()}


def by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value with the places where it stands, in order."""
    order = np.argsort(values, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(values[order], prepend=values[order][:1] - 1 if len(order) else None) != 0), len(order)) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(values[order[a]]), order[a:b]


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of one stretch of bytes: hash of the anchor, of the block, first window, windows."""
    spans = Spans(data)
    grams = spans.all_of(gram)
    place = np.uint64((1 << 24) - 1)
    least = window_minima((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(first, len(least)))
    return grams[(least[first] & place).astype(np.int64)], spans.hashes(first, first + n - 1 + length), first, n


def blocks_of(texts: pa.Array, rids: np.ndarray, length: int, gram: int) -> Iterator[dict[str, np.ndarray]]:
    data, offsets = raw_bytes(texts)
    for a, b in some_at_a_time(offsets):
        big = offsets[a + 1] - offsets[a] > SEGMENT
        at, end = int(offsets[a]), int(offsets[b])
        while end - at >= length:
            stop = min(end, at + SEGMENT + length - 1) if big else end
            h, c, first, n = runs_of(data[at:stop], length, gram)
            if big:
                doc = np.full(len(first), a)
            else:  # cut the runs at the ends of texts: only windows inside one text are kept
                doc = np.searchsorted(offsets, at + first, "right") - 1
                last = offsets[doc + 1] - at - length  # the last window of that text
                inside = (first + n - 1 <= last) & (np.searchsorted(offsets, at + first + n - 1, "right") - 1 == doc)
                crossing = np.flatnonzero(~inside)
                h, c, first, n, doc = (np.concatenate([x[inside], y]) for x, y in zip((h, c, first, n, doc), cut_runs(data[at:stop], offsets[a : b + 1] - at, a, h[crossing], first[crossing], n[crossing], length, gram), strict=True))
            yield {"h": h, "c": c, "rid": rids[doc], "s": first + at - offsets[doc], "n": n}
            at = stop - length + 1 if stop < end else end


def cut_runs(data: np.ndarray, offsets: np.ndarray, base: int, h: np.ndarray, first: np.ndarray, n: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """What is left of runs that reach over the end of a text: their windows inside one text, as runs again."""
    windows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    run = np.repeat(np.arange(len(n)), n)
    doc = np.searchsorted(offsets, windows, "right") - 1
    keep = windows + length <= offsets[np.minimum(doc + 1, len(offsets) - 1)]
    windows, run, doc = windows[keep], run[keep], doc[keep]
    new = np.ones(len(windows), bool)
    new[1:] = (np.diff(run) != 0) | (np.diff(doc) != 0) | (np.diff(windows) != 1)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(windows)))
    spans = Spans(data)
    return h[run[begin]], spans.hashes(windows[begin], windows[begin] + size - 1 + length), windows[begin], size, doc[begin] + base


def repeats(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of blocks by anchor, content, document and place; and which of them repeat the block before."""
    order = np.lexsort((columns["s"], columns["rid"], columns["c"], columns["h"]))
    h, c = columns["h"][order], columns["c"][order]
    again = np.zeros(len(order), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    return order, again


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A class for each start: the same for equal windows.  By suffix array, and adjacent prefixes compared."""
    place = np.full(len(text), -1)
    place[starts] = np.arange(len(starts))
    order = place[suffix_array(text)]
    order = order[order >= 0]
    at = starts[order]
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 20_000):
        b = min(len(order), a + 20_000)
        rows = np.lib.stride_tricks.sliding_window_view(text, length)[at[a - 1 : b]]
        same[a:b] = (rows[1:] == rows[:-1]).all(axis=1)
    out = np.empty(len(starts), np.int64)
    out[order] = np.cumsum(~same)
    return out


def whole_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The same classes, by sorting the windows' bytes: for one anchor with more bytes than a suffix array takes.

    Windows are ordered by 8 bytes after the other; only those that are equal so far are looked at again, so equal windows are compared in full."""
    views = np.lib.stride_tricks.sliding_window_view(np.append(text, np.zeros(8, np.uint8)), 8)
    classes, open_ = np.zeros(len(starts), np.int64), np.arange(len(starts))
    for at in range(0, length, 8):
        at = min(at, max(0, length - 8))
        part = np.ascontiguousarray(views[starts[open_] + at]).view(">u8").ravel()
        if length < 8:
            part = part >> np.uint64(8 * (8 - length))
        by = np.lexsort((part, classes[open_]))
        same = (classes[open_][by][1:] == classes[open_][by][:-1]) & (part[by][1:] == part[by][:-1])
        first = np.append(True, ~same)
        new = np.empty(len(by), np.int64)
        new[by] = open_[by][np.flatnonzero(first)][np.cumsum(first) - 1]  # a class is named by one of its windows
        classes[open_] = new + 1
        alone = np.empty(len(by), bool)
        alone[by] = first & np.append(first[1:], True)
        open_ = open_[~alone]
        if not len(open_):
            break
    return classes


def sorted_blocks(blocks: dict[str, np.ndarray], raw: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Marks of all windows of these blocks (their bytes in a row in raw) that start earlier in another one."""
    size = blocks["n"].astype(np.int64) - 1 + length
    begin = np.cumsum(size) - size
    order = np.argsort(blocks["h"], kind="stable")
    cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(blocks["h"][order]) != 0])), len(order)) if len(order) else np.zeros(1, int)
    weight = np.append(0, np.cumsum(size[order]))
    marks: list[tuple[np.ndarray, np.ndarray]] = []
    k = 0
    while k < len(cuts) - 1:
        last = max(k + 1, int(np.searchsorted(weight[cuts], weight[cuts[k]] + MOST // 2, "right")) - 1)
        mine = order[cuts[k] : cuts[last]]
        n, bytes_of = blocks["n"][mine].astype(np.int64), size[mine]
        own = np.cumsum(bytes_of) - bytes_of
        text = raw[np.repeat(begin[mine] - own, bytes_of) + np.arange(bytes_of.sum())]
        run = np.repeat(np.arange(len(mine)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = own[run] + nth
        if len(text) <= MOST - 4:
            classes = equal_windows(text, starts, length)
        else:
            classes = whole_windows(text, starts, length)
        rid, s = blocks["rid"][mine][run], blocks["s"][mine][run] + nth
        by = np.lexsort((s, rid, classes))
        again = np.zeros(len(by), bool)
        again[1:] = classes[by][1:] == classes[by][:-1]
        marks.append((rid[by][again], s[by][again]))
        k = last
    rid = np.concatenate([m[0] for m in marks]) if marks else np.empty(0, np.int64)
    s = np.concatenate([m[1] for m in marks]) if marks else np.empty(0, np.int64)
    by = np.lexsort((s, rid))
    rid, s = rid[by], s[by]
    new = np.ones(len(rid), bool)
    new[1:] = (np.diff(rid) != 0) | (np.diff(s) != 1)
    first = np.flatnonzero(new)
    return {"rid": rid[first], "s": s[first], "n": np.diff(np.append(first, len(rid)))}


def by_document(kind: int, columns: dict[str, np.ndarray], kinds: list[tuple[str, str]]) -> Iterator[tuple[int, int, bytes]]:
    for rid, at in by_value(columns["rid"]):
        yield kind, rid, packed(columns, kinds, at)


def table_of(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds, rids, raw = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"kind": pa.array(kinds, pa.int32()), "rid": pa.array(rids, pa.int64()), "raw": pa.array(raw, pa.binary())})


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rid unique, text) -> (rid, marks array<binary>): the repeated windows of each document that has any, as packed (start, count)."""
    buckets = max(1, -(-int(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BUCKET_BYTES))
    after = [("s", "<i4"), ("n", "<i4")]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = {k: np.concatenate([x[k] for x in held]) for k, _ in RUN}
            held.clear()
            order, again = repeats(columns)
            out = [(bucket, 0, packed(columns, RUN, np.sort(order[~again])[at])) for bucket, at in by_value((columns["h"][np.sort(order[~again])] >> np.uint64(20)).astype(np.int64) % buckets)]
            if again.any():
                out.append((int(columns["h"][0] >> np.uint64(20)) % buckets, 1, packed(columns, MARK, order[again])))
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["bucket", "kind", "raw"])

        for batch in batches:
            for found in blocks_of(batch.column(1), batch.column(0).to_numpy(), length, gram):
                held.append(found)
                if sum(len(x["h"]) for x in held) >= RUNS_AT_ONCE:
                    yield from flush()
        if sum(len(x["h"]) for x in held):
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        kinds, raw = table["kind"].to_pylist(), table["raw"].to_pylist()
        out = list(by_document(1, unpacked([r for k, r in zip(kinds, raw, strict=True) if k == 1], MARK), after))
        columns = unpacked([r for k, r in zip(kinds, raw, strict=True) if k == 0], RUN)
        order, again = repeats(columns)
        columns = {k: v[order] for k, v in columns.items()}
        out += by_document(1, {k: v[again] for k, v in columns.items()}, after)
        columns = {k: v[~again] for k, v in columns.items()}
        group = np.cumsum(np.concatenate([[True], np.diff(columns["h"]) != 0])) if len(columns["h"]) else np.empty(0, np.int64)
        blocks = np.bincount(group, minlength=1)[group] if len(group) else group
        shared = blocks > 1
        columns["ways"] = np.where(blocks > HOT_BLOCKS, -(-blocks // (HOT_BLOCKS // 4)), 1)
        out += by_document(0, {k: v[shared] for k, v in columns.items()}, ASK)
        return table_of(out)

    found = rows.mapInArrow(anchors, "bucket long, kind int, raw binary").groupBy("bucket").applyInArrow(meet, "kind int, rid long, raw binary")
    found = stored(found, "blocks")
    asked = found.filter("kind = 0")
    ask_bytes = sum(np.dtype(t).itemsize for _, t in ASK)
    fetched = int(asked.agg(F.sum(F.length("raw").cast("long"))).first()[0] or 0) // ask_bytes * (length + 34)
    shelves = max(1, -(-fetched // (BUCKET_BYTES // 3)))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(1))
            columns: dict[str, list[np.ndarray]] = {k: [] for k, _ in BLOCK}
            begin: list[np.ndarray] = []
            for k, parts in enumerate(batch.column(2).to_pylist()):
                asks = unpacked(parts, ASK)
                h, s, n, ways = asks["h"], asks["s"].astype(np.int64), asks["n"].astype(np.int64), asks["ways"]
                hot = ways > 1
                if hot.any():  # single windows, dealt out by their own hash
                    run = np.repeat(np.flatnonzero(hot), n[hot])
                    nth = np.arange(len(run)) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    single = s[run] + nth
                    own = Spans(data[offsets[k] : offsets[k + 1]]).hashes(single, single + length)
                    h = np.concatenate([h[~hot], mix(h[run] + own % ways[run].astype(np.uint64))])
                    s, n = np.concatenate([s[~hot], single]), np.concatenate([n[~hot], np.ones(len(run), np.int64)])
                for name, x in (("h", h), ("rid", np.full(len(h), batch.column(0)[k].as_py())), ("s", s), ("n", n)):
                    columns[name].append(x)
                begin.append(offsets[k] + s)
            whole = {k: np.concatenate(v) for k, v in columns.items()} if begin else {}
            if not begin or not len(whole["h"]):
                continue
            at_byte, size = np.concatenate(begin), whole["n"] - 1 + length
            out = []
            for shelf, at in by_value((whole["h"] >> np.uint64(20)).astype(np.int64) % shelves):
                total = size[at].sum()
                where = np.repeat(at_byte[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(total)
                out.append((shelf, packed(whole, BLOCK, at), data[where].tobytes()))
            a, b, c = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary()), pa.array(c, pa.binary())], names=["shelf", "blocks", "bytes"])

    def sort(table: pa.Table) -> pa.Table:
        blocks = unpacked(table["blocks"].to_pylist(), BLOCK)
        raw = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        return table_of(list(by_document(1, sorted_blocks(blocks, raw, length), after)))

    needed = asked.groupBy("rid").agg(F.collect_list("raw").alias("asks"))
    shelved = rows.join(needed, "rid").select("rid", "text", "asks").mapInArrow(fetch, "shelf long, blocks binary, bytes binary")
    more = stored(shelved.groupBy("shelf").applyInArrow(sort, "kind int, rid long, raw binary"), "sorted")
    return found.filter("kind = 1").select("rid", "raw").union(more.select("rid", "raw")).groupBy("rid").agg(F.collect_list("raw").alias("marks"))


def merged(marks: list[bytes] | None, length: int) -> np.ndarray:
    """Maximal removed spans, (start, end) rows, from the packed marks of a document."""
    if not marks:
        return np.empty((0, 2), np.int64)
    found = unpacked(marks, [("s", "<i4"), ("n", "<i4")])
    order = np.argsort(found["s"], kind="stable")
    a = found["s"][order].astype(np.int64)
    b = np.maximum.accumulate(a + found["n"][order] - 1 + length)
    first = np.concatenate([[True], a[1:] > b[:-1]])
    last = np.concatenate([first[1:], [True]])
    return np.stack([a[first], b[last]], axis=1)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> (id_col, n_bytes, spans array<array<long>>, kept binary, text, and the columns in keep).

    spans are the maximal removed runs [start, end) in bytes; kept is what is left; text is that too, but a character of
    which a byte is left stays whole, so that it is UTF-8."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

    bounded_batches(docs.sparkSession)
    wanted = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text"), *(F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)))
    rows, _ = unique_ids(wanted, "id_", "text")
    marks = repeated_spans(rows.select("rid", "text"), length, gram)
    both = rows.join(marks, "rid", "left").drop("rid")
    both = both.select("id_", *(f"keep_{k}" for k in range(len(keep))), "text", "marks")
    width = 1 + len(keep)
    schema = StructType([*both.schema.fields[:width], StructField("n_bytes", LongType()), StructField("spans", ArrayType(ArrayType(LongType()))), StructField("kept", BinaryType()), StructField("text", StringType())])
    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column(width))
            sizes, spans, kept, texts = [], [], [], []
            given = batch.column(width).is_null().to_pylist()
            for k, marked in enumerate(batch.column(width + 1).to_pylist()):
                own = data[offsets[k] : offsets[k + 1]]
                gone = merged(marked, length)
                sizes.append(len(own))
                spans.append(gone.tolist())
                if not len(gone):
                    kept.append(own.tobytes())
                    texts.append(None if given[k] else own.tobytes())
                    continue
                left = np.ones(len(own), bool)
                for a, b in gone:
                    left[a:b] = False
                kept.append(own[left].tobytes())
                lead = np.flatnonzero((own & 0xC0) != 0x80)
                texts.append(own[np.repeat(np.logical_or.reduceat(left, lead), np.diff(np.append(lead, len(own))))].tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), pa.array(texts, pa.binary()).cast(pa.string())], names=names)

    out = both.mapInArrow(cut, schema)
    return out.withColumnsRenamed({"id_": id_col} | {f"keep_{k}": c for k, c in enumerate(keep)})
