"""Byte-level BPE encoding and decoding of whole texts.

Texts are cut where the pre-tokenizer cuts in any context (see tokens); each distinct piece is encoded once.
What stays unsplit and long is encoded by tree concatenation: halves are encoded on their own, then a window around
the join is encoded again and grown until its first and last tokens are those that both sides already have.
BPE tokens follow one another rightly if every two neighbours do, so what lies outside such a window stands.
Long texts are cut into halves, again and again, before that: the parts are encoded by different tasks and
concatenated as a tree by the same rule, with windows that grow by whole pieces.

Null texts count as empty; an empty text has no ids and decodes to an empty text.  Rows are independent: repeated
rows, ties and null ids are kept.  Other columns are dropped, so their names cannot clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .tokens import SAFE_CUT, byte_letters, memo

LONG_TEXT = 64 << 10
UNSPLIT = 1 << 10
LEAF = 256


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id.  Added tokens stand for their own text."""
    library, back = memo(path).library, byte_letters()[1]
    added = library.get_added_tokens_decoder()
    table = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        table[i] = token.encode() if i in added else bytes(back[c] for c in token)
    return table


def joined(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], table: list[bytes]) -> list[int]:
    """Ids of two texts that follow one another, from the ids of each."""
    if not left or not right:
        return left + right
    a = b = 1
    while True:
        a, b = min(a, len(left)), min(b, len(right))
        window = encode(b"".join(table[i] for i in [*left[-a:], *right[:b]]))
        left_ok = a == len(left) or window[0] == left[-a]
        right_ok = b == len(right) or window[-1] == right[b - 1]
        if left_ok and right_ok and (len(window) > 1 or a == len(left) and b == len(right)):
            return left[: len(left) - a] + window + right[b:]
        a, b = a if left_ok and len(window) > 1 else 2 * a, b if right_ok and len(window) > 1 else 2 * b


def unsplit_ids(raw: bytes, path: str, leaf: int = LEAF) -> list[int]:
    """Ids of one pre-token by tree concatenation."""
    model, letters, table = memo(path).library.model, byte_letters()[0], byte_table(path)

    def encode(part: bytes) -> list[int]:
        return [t.id for t in model.tokenize("".join(letters[b] for b in part))]

    def tree(part: bytes) -> list[int]:
        if len(part) <= leaf:
            return encode(part)
        half = len(part) // 2
        return joined(tree(part[:half]), tree(part[half:]), encode, table)

    return tree(raw)


def text_ids(text: str, path: str) -> list[int]:
    """Ids of one text: long pre-tokens as trees, the rest by the library."""
    own = memo(path)
    if len(text) <= UNSPLIT:
        return np.frombuffer(b"".join(own.encode_alone([text])), np.int32).tolist()
    out: list[int] = []
    short: list[str] = []

    def flush() -> None:
        if short:
            out.extend(np.frombuffer(b"".join(own.encode_alone(["".join(short)])), np.int32).tolist())
            short.clear()

    for piece in SAFE_CUT.split(text):
        if len(piece) <= UNSPLIT:
            short.append(piece)
            continue
        flush()
        parts, added = [piece], {t.content: i for i, t in own.library.get_added_tokens_decoder().items()}
        for token in added:  # added tokens are cut out first, as the library does
            parts = [y for x in parts for y in with_token(x, token, added)]
        for part in parts:
            if part in added:
                out.append(added[part])
                continue
            for pre, (a, b) in own.library.pre_tokenizer.pre_tokenize_str(part):
                raw = part[a:b].encode()
                out.extend(unsplit_ids(raw, path) if len(raw) > UNSPLIT else [t.id for t in own.library.model.tokenize(pre)])
    flush()
    return out


def with_token(part: str, token: str, added: dict[str, int]) -> list[str]:
    if part in added:
        return [part]
    between = part.split(token)
    return [x for k, p in enumerate(between) for x in ([token] * (k > 0) + [p] * bool(p))]


def ids_of(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, int32, and where each text's ids start (and the end)."""
    own = memo(path)
    pieces, starts = own.pieces(texts)
    long = pc.greater(pc.binary_length(pieces), UNSPLIT).to_numpy(zero_copy_only=False)
    if not long.any():
        return own.ids(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    apart = np.zeros(len(texts), bool)
    apart[owner[long]] = True
    ids, bounds = own.ids(texts.filter(pa.array(~apart))) if (~apart).any() else (np.empty(0, np.int32), np.zeros(1, np.int64))
    parts, k = [], 0
    for i in range(len(texts)):
        if apart[i]:
            parts.append(np.array(text_ids(texts[i].as_py(), path), np.int32))
        else:
            parts.append(ids[bounds[k] : bounds[k + 1]])
            k += 1
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    return np.concatenate(parts), ends


def halves(text: str, most: int) -> list[str]:
    """The leaves of a tree of halves, none over `most` bytes unless it is one character."""
    if len(text) < 2 or len(text.encode()) <= most:
        return [text]
    half = len(text) // 2
    return halves(text[:half], most) + halves(text[half:], most)


def concatenated(parts: list[tuple[str, list[int]]], path: str) -> list[int]:
    """Ids of the texts in a row, from those of each, as a tree; windows around a join grow by whole pieces."""
    table = byte_table(path)
    while len(parts) > 1:
        level = []
        for k in range(0, len(parts) - 1, 2):
            level.append(join_texts(*parts[k], *parts[k + 1], path, table))
        parts = level + parts[len(parts) // 2 * 2 :]
    return parts[0][1]


def join_texts(left: str, left_ids: list[int], right: str, right_ids: list[int], path: str, table: list[bytes]) -> tuple[str, list[int]]:
    a_cuts = [0, *(m.start() for m in SAFE_CUT.finditer(left))]
    b_cuts = [*(m.start() for m in SAFE_CUT.finditer(right)), len(right)]
    a = b = 1
    while True:
        a, b = min(a, len(a_cuts)), min(b, len(b_cuts))
        x, y = a_cuts[-a], b_cuts[b - 1]
        window = text_ids(left[x:] + right[:y], path)
        l_tail, r_head = len(left[x:].encode()), len(right[:y].encode())
        keep, drop = tail_tokens(left_ids, l_tail, table), tail_tokens(right_ids[::-1], r_head, table)
        inner, outer = left_ids[len(left_ids) - keep :], right_ids[:drop]
        left_ok = x == 0 or a > 1 and window[:1] == inner[:1]
        right_ok = y == len(right) or b > 1 and window[-1:] == outer[-1:]
        if left_ok and right_ok:
            return left + right, left_ids[: len(left_ids) - keep] + window + right_ids[drop:]
        a, b = a if left_ok else 2 * a, b if right_ok else 2 * b


def tail_tokens(ids: list[int], size: int, table: list[bytes]) -> int:
    """How many of the last ids hold the last `size` bytes (a cut that pre-tokens never cross)."""
    n = 0
    while size > 0:
        n += 1
        size -= len(table[ids[-n]])
    return n


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """docs -> (id_col, ids array<int>): ids of every whole text, without added tokens at its ends.

    A text over long_text bytes is cut into halves that other tasks encode; its parts meet again by a row key."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = ids_of(pc.fill_null(batch.column(1), ""), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], names=["id", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = halves(text, long_text // 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(parts), pa.int64()), pa.array([i] * len(parts), batch.column(1).type), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())],
                    names=["key", "id", "part", "text"])

    def parts_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = ids_of(batch.column(3), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], names=["key", "id", "part", "text", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ids = concatenated(list(zip(table["text"].to_pylist(), table["ids"].to_pylist(), strict=True)), path)
        return pa.table({"id": table["id"].slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    near = rows.filter(size <= long_text).mapInArrow(short, f"id {kind}, ids array<int>")
    cut = rows.filter(size > long_text).select(F.monotonically_increasing_id().alias("key"), "id", "text")
    cut = stored(cut.mapInArrow(leaves, f"key long, id {kind}, part int, text string"), "halves")  # the keys stay as they are
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    far = cut.repartition(n, "key", "part").mapInArrow(parts_ids, f"key long, id {kind}, part int, text string, ids array<int>")
    far = far.groupBy("key").applyInArrow(whole, f"id {kind}, ids array<int>")
    return near.unionByName(far).withColumnRenamed("id", id_col)


def texts_of(lists: pa.ListArray, table: list[bytes]) -> pa.Array:
    """The text of each list of ids: the bytes of all ids gathered at once."""
    size, blob = np.array([len(x) for x in table], np.int64), np.frombuffer(b"".join(table), np.uint8)
    first = np.cumsum(size) - size
    starts = lists.offsets.to_numpy()
    ids = lists.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    null = lists.is_null().to_numpy(zero_copy_only=False)
    ends = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size[ids], out=ends[1:])
    data = blob[np.arange(ends[-1]) + np.repeat(first[ids] - ends[:-1], size[ids])]
    bounds, raw = ends[starts - starts[0]], data.tobytes()
    inner = bounds[bounds < len(data)]
    try:
        raw.decode()
        sound = not np.any((data[inner] & 0xC0) == 0x80)  # no character lies over the end of a text
    except UnicodeDecodeError:
        sound = False
    if sound and not null.any():
        return pa.StringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw))
    return pa.array([None if null[k] else raw[a:b].decode("utf-8", "replace") for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], pa.string())


def decode(rows: DataFrame, path: str, ids_col: str = "ids", to: str = "text") -> DataFrame:
    """Adds the text that the ids of each row stand for, special tokens included; bytes that are not
    UTF-8 become U+FFFD.  Null ids: a null text.  A column already called `to` is replaced."""
    from pyspark.sql.types import StringType, StructField, StructType

    bounded_batches(rows.sparkSession)
    kept = rows.drop(to)
    names, at = [*kept.columns, to], kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, texts_of(batch.column(at), table)], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(to, StringType())]))
