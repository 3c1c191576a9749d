"""Packing: concatenate and cut.

Pass one encodes every document, adds the end id, and writes the ids with the document's place among those of its
partition.  The token totals of the partitions (a row each) give every partition its global offset as a prefix
sum.  Pass two cuts the one long row of ids into windows; a document that lies over a window's end
gives a record for each side of that boundary.  All sequences but the last are full.

Null texts count as empty: such a document is its end id alone.  Repeated rows and null ids are packed like any
others.  Columns other than the id and the text are dropped, so their names cannot clash.  An empty table
gives no pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small_table, stored
from .tokens import memo

WINDOW = 4096


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(part, before, id, n, ids): ids as little-endian unsigned 16-bit numbers, or 32-bit ones for large vocabularies."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, before = memo(path), TaskContext.get().partitionId(), 0
        width = np.dtype("<u2" if max(own.library.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, starts = own.ids(batch.column(1))
            ids = np.insert(ids, starts[1:], end_id).astype(width)
            starts = starts + np.arange(len(starts))
            sizes = np.diff(starts)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(starts * width.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(before + starts[:-1]), batch.column(0), pa.array(sizes), binary],
                names=["part", "before", "id", "n", "ids"])
            before += int(starts[-1])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"part int, before long, id {kind}, n long, ids binary")


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> pieces (id_col, start, length, doc_tokens, sequence_id, offset, ids): ids are little-endian unsigned 32-bit numbers."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    own = stored(encoded(docs, path, end_id, id_col, text_col), "ids")
    totals = own.groupBy("part").agg(F.sum("n").alias("tokens")).orderBy("part").collect()  # a row for each partition
    before = np.cumsum([0, *(r["tokens"] for r in totals)]).tolist()
    bases = small_table(spark, [(r["part"], base) for r, base in zip(totals, before, strict=False)], "part int, base long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            raw = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            width = (offsets[1] - offsets[0]) // n[0]
            ids = np.frombuffer(raw.buffers()[2], f"<u{width}", int(offsets[-1] - offsets[0]) // width, int(offsets[0])).astype("<u4")
            pieces = (at + n - 1) // window - at // window + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[doc] // window + nth
            begin = np.maximum(at[doc], sequence * window)
            length = np.minimum(at[doc] + n[doc], (sequence + 1) * window) - begin
            bounds = np.zeros(len(doc) + 1, np.int64)
            np.cumsum(length * 4, out=bounds[1:])  # the pieces lie in a row, as the ids do
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(bounds), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (begin - at[doc], length, n[doc], sequence, begin - sequence * window)), out],
                names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = own.join(bases, "part").select((F.col("base") + F.col("before")).alias("at"), "id", "n", "ids")
    return placed.mapInArrow(cut, f"id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", id_col)
