"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets features of its own bytes and words, and those of its neighbour lines; the field labels each line good or bad. A
document's quality is the length-weighted mean of its lines' forward-backward marginals, put through a logistic curve
that is fitted to the labelled documents.

The field is fitted on the driver, on at most `sample` labelled documents of each class with at most `sample_lines` lines (those with the smallest
hashes of their id); counts of the classes weigh them.  Labels are of documents: each line is fitted to
its document's label.  Scoring reads every whole text and needs the
weights alone, some hundred numbers.

Null and empty texts are one empty line and get a score like any other.  Without labels of both classes every score is the share of good labels (0.5 without any).
Repeated rows and null ids are scored like others; labels that are null or have no document are not used; of several labels of an id one is taken. Input columns other
than the id and the text are never read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .hashing import Spans, mix, raw_bytes, some_at_a_time

SAMPLE = 1500
SAMPLE_LINES = 2000
THRESHOLD = 0.3
FEATURES = ("bias", "upper", "digit", "space", "mark", "point", "piped", "marked", "distinct", "same", "again", "length", "word", "empty")
_kind = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 space, 5 mark, 6 point, 7 bar
_kind[65:91] = 1
_kind[97:123] = 2
_kind[128:] = 2
_kind[48:58] = 3
_kind[[32, *range(9, 14)]] = 4
_kind[[ord(c) for c in "!#$%&*@^~<>={}[]\\_+"]] = 5
_kind[[ord(c) for c in ".,;:?'\"()-"]] = 6
_kind[ord("|")] = 7


def line_features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: number of the first, features of each line, bytes of each line, where each text's lines start (and the end)."""
    data, offsets = raw_bytes(texts)
    for a, b in some_at_a_time(offsets):
        own = offsets[a : b + 1] - offsets[a] + np.arange(b - a + 1)
        part = np.full(int(own[-1]), 10, np.uint8)  # a line end behind each text
        keep = np.ones(len(part), bool)
        keep[own[1:] - 1] = False
        part[keep] = data[offsets[a] : offsets[b]]
        ends = np.flatnonzero(part == 10)
        starts = np.append(0, ends[:-1] + 1)
        doc_lines = np.searchsorted(starts, own)
        kind = _kind[part]

        def share(hit: np.ndarray, starts=starts, ends=ends) -> np.ndarray:
            total = np.zeros(len(hit) + 1, np.int64)
            np.cumsum(hit, out=total[1:])
            return total[ends] - total[starts]

        size = ends - starts
        letters = np.maximum(share((kind == 1) | (kind == 2)), 1)
        at_least = np.maximum(size, 1)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], kind != 4]).astype(np.int8)))
        w_start, w_end = edges[::2], edges[1::2]
        line = np.searchsorted(starts, w_start, "right") - 1
        n = np.bincount(line, minlength=len(starts))
        words = np.maximum(n, 1)
        spans = Spans(part)
        hashes = spans.hashes(w_start, w_end)
        per_line = lambda hit: np.bincount(line[hit], minlength=len(starts)) / words
        first = np.zeros(len(hashes), bool)
        first[np.unique(mix(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]] = True
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
        doc = np.repeat(np.arange(b - a), np.diff(doc_lines))
        again = np.ones(len(starts))
        again[np.unique(mix(spans.hashes(starts, ends) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_index=True)[1]] = 0
        again[size == 0] = 0
        yield a, np.stack([
            np.ones(len(starts)), share(kind == 1) / letters, share(kind == 3) / at_least, share(kind == 4) / at_least, np.minimum(1, 4 * share(kind == 5) / at_least),
            np.minimum(1, 10 * share(kind == 6) / at_least), per_line((kind[w_start] == 7) & (w_end - w_start == 1)), per_line(kind[w_end - 1] == 5), np.where(n, per_line(first), 1),
            per_line(same), again, np.minimum(1, np.log1p(size) / 8), np.minimum(1, letters / words / 16), (size == 0).astype(float)], axis=1), size + 1, doc_lines


def with_neighbours(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Features of the line, of the line before and of the line after (zeros at the ends of a text)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


def marginals(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward for all chains at once, position by position.

    scores: log-odds of good for each line; moves: 2 x 2 log weights (bad, good).
    Returns P(good) of each line, expected moves, and the log of all partition sums."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = bounds[:-1][order], int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")
    emit = np.stack([np.ones(len(scores)), np.exp(np.clip(scores, -40, 40))], axis=1)
    step, forward, backward = np.exp(moves), np.zeros((len(scores), 2)), np.ones((len(scores), 2))
    log_sum = 0.0
    for t in range(longest):
        at = begin[: alive[t]] + t
        f = emit[at] * (1.0 if t == 0 else forward[at - 1] @ step)
        total = f.sum(axis=1, keepdims=True)
        log_sum += float(np.log(total).sum())
        forward[at] = f / total
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1]
        pair = forward[at][:, :, None] * step[None] * ahead[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        g = ahead @ step.T
        backward[at] = g / g.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), expected, log_sum


def fit_field(x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and of the moves: conditional likelihood with a small penalty, by Adam on all chains."""
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[bounds[1:] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at], labels[at + 1]), 1)
    theta = np.concatenate([w, moves.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = marginals(x @ w, bounds, moves)
        slope = np.concatenate([x.T @ (labels - good), (seen - expected).ravel()]) / len(x) - 1e-4 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta = theta + 0.2 * (1 - k / (rounds + 20)) * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return theta[:-4], theta[-4:].reshape(2, 2)


def mean_good(good: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])


def curve(means: np.ndarray) -> np.ndarray:
    m = np.clip(means, 1e-3, 1 - 1e-3)
    return np.log(m / (1 - m))


def fit_curve(means: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton's method with a small penalty."""
    z = np.stack([curve(means), np.ones(len(means))], axis=1)
    theta = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -40, 40)))
        slope = z.T @ (weights * (labels - p)) - 1e-3 * theta
        bend = (z * (weights * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> dict:
    """The model as plain numbers.  labels: (id_col, label_col 0 or 1), only rows that may be learnt from."""
    bounded_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return {"share": float(next(iter(counts), 0.5))}
    picked = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    picked = picked[0].union(picked[1]).groupBy("id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")  # at most 2 * sample rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, given = batch.column(0), batch.column(2).to_numpy()
            for a, x, weight, bounds in line_features(batch.column(1)):
                n = len(bounds) - 1
                own = [k for k in range(n) if bounds[k + 1] - bounds[k] <= sample_lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[a + k].as_py() for k in own], pa.string()), pa.array(given[a : a + n][own].astype(np.int32)), pa.array([x[bounds[k] : bounds[k + 1]].astype(np.float32).tobytes() for k in own], pa.binary()), pa.array([weight[bounds[k] : bounds[k + 1]].astype(np.float32).tobytes() for k in own], pa.binary())],
                    names=["id", "label", "x", "weight"])

    got = rows.select(F.col("id").cast("string").alias("id"), "text", "label").mapInArrow(run, "id string, label int, x binary, weight binary").collect()
    got = sorted(got, key=lambda r: (r["id"], bytes(r["x"])))
    width = len(FEATURES)
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in got]
    given = np.array([r["label"] for r in got])
    if len(set(given.tolist())) < 2:
        return {"share": counts[1] / sum(counts.values())}
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = with_neighbours(np.concatenate(parts).astype(float), bounds)
    weight = np.concatenate([np.frombuffer(r["weight"], np.float32) for r in got]).astype(float)
    doc = np.repeat(np.arange(len(parts)), np.diff(bounds))
    field = fit_field(x, bounds, given[doc])
    means = mean_good(marginals(x @ field[0], bounds, field[1])[0], weight, bounds)
    of_class = np.array([counts[k] / max(1, (given == k).sum()) for k in (0, 1)])
    slope, height = fit_curve(means, given, of_class[given] / of_class.mean())
    return {"field": field[0].tolist(), "moves": field[1].tolist(), "slope": slope, "height": height}


def scores_of(texts: pa.Array, model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(texts), model["share"])
    out = np.empty(len(texts))
    field, moves = np.array(model["field"]), np.array(model["moves"])
    for a, x, weight, bounds in line_features(texts):
        good = marginals(with_neighbours(x, bounds) @ field, bounds, moves)[0]
        z = model["slope"] * curve(mean_good(good, weight.astype(float), bounds)) + model["height"]
        out[a : a + len(bounds) - 1] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return out


def score(docs: DataFrame, model: dict, text_col: str = "text", to: str = "score") -> DataFrame:
    """docs with the column `to`, double from 0 to 1; a column of that name is replaced."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    bounded_batches(docs.sparkSession)
    kept = docs.drop(to)
    names, at = [*kept.columns, to], kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores_of(batch.column(at), model))], names=names)

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(to, DoubleType())]))


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that are not held out: those whose id's crc32, as text, is not divisible by 5."""
    return labels.filter(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
