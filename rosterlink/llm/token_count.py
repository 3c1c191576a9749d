"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text of up to HUGE bytes is counted piece by piece (see tokens).  A longer one is cut into chunks that overlap;
each chunk is encoded with the byte offset of every token.  Two neighbours are spliced at a boundary inside
their overlap at which the pre-tokenizer cuts in any context (proof in tokens) and at which both encodings do end
a token, with the same tokens from there to the next such place.  If no boundary fits, the overlap is doubled.

Null and empty texts count 0 tokens and 0 bytes.  Rows are independent: repeated rows, ties and null ids are
kept as they are.  Columns of the input other than the id and the text are dropped, so their names cannot clash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_table
from .common import bounded_batches
from .tokens import SAFE_CUT, memo

HUGE = 32 << 10
CHUNK = 16 << 10
OVERLAP = 128


def boundaries(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte offsets at which a token starts or the text ends."""
    out = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(sizes[ids], out=out[1:])
    return out


def spliced_count(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text by overlapping chunks of about so many characters."""
    own = memo(path)
    sizes = np.array([len(x) for x in byte_table(path)], np.int64)

    def encoded(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        ids, _ = own.ids(pa.array([text[a:b]]))
        return ids, boundaries(ids, sizes)

    n, start, total = len(text), 0, 0
    end = min(n, chunk)
    ids, bounds = encoded(start, end)
    while end < n:
        wide = overlap
        while True:
            back = max(start + 1, end - wide)
            upto = min(n, max(end, back + chunk))
            more, more_bounds = encoded(back, upto)
            at = splice(text, start, end, back, ids, bounds, more, more_bounds)
            if at is not None:
                break
            if back == start + 1:  # the whole chunk is one unsplit piece: take it and what follows together
                at, end = start, min(n, end + wide)
                ids, bounds = encoded(start, end)
            wide *= 2
            if end == n:
                break
        if at is None or at == start and end == n:
            break
        if at > start:
            total += int(np.searchsorted(bounds, len(text[start:at].encode())))
            cut = int(np.searchsorted(more_bounds, len(text[back:at].encode())))
            ids, bounds = more[cut:], more_bounds[cut:] - more_bounds[cut]
            start, end = at, upto
    return total + len(ids)


def splice(text: str, start: int, end: int, back: int, ids, bounds, more, more_bounds) -> int | None:
    """A place in text[back:end], after start, where both encodings may be joined."""
    cuts = [back + m.start() for m in SAFE_CUT.finditer(text[back:end])]
    for at, until in zip(cuts, cuts[1:], strict=False):
        a, b = (int(x) for x in np.searchsorted(bounds, [len(text[start:at].encode()), len(text[start:until].encode())]))
        c, d = (int(x) for x in np.searchsorted(more_bounds, [len(text[back:at].encode()), len(text[back:until].encode())]))
        whole = bounds[a] == len(text[start:at].encode()) and more_bounds[c] == len(text[back:at].encode())
        if whole and a < b and np.array_equal(ids[a:b], more[c:d]):
            return at
    return None


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """docs -> (id_col, n_bytes, n_tokens): tokens of every whole text as the tokenizers library gives them."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = memo(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            long = size > huge
            counts = np.zeros(len(size), np.int64)
            if (~long).any():
                counts[~long] = own.counts(texts.filter(pa.array(~long)))
            for i in np.flatnonzero(long):
                counts[i] = spliced_count(texts[int(i)].as_py(), path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(counts)], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
