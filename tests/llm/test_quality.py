import numpy as np
import pyarrow as pa
import pytest
from itertools import product

from rosterlink.llm import quality


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 4, 5, 11])
    scores, moves = rng.normal(size=11) * 2, rng.normal(size=(2, 2))
    good, expected, log_sum = quality.marginals(scores, bounds, moves)
    total, want, want_moves = 0.0, np.zeros(11), np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        weights = {}
        for y in product((0, 1), repeat=b - a):
            weights[y] = np.exp(sum(s * v for s, v in zip(scores[a:b], y)) + sum(moves[i, j] for i, j in zip(y, y[1:])))
        z = sum(weights.values())
        total += np.log(z)
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for i, j in zip(y, y[1:]):
                want_moves[i, j] += w / z
    assert np.allclose(good, want) and np.allclose(expected, want_moves) and np.isclose(total, log_sum)


def test_features_know_their_line():
    (_, x, weight, bounds), = quality.line_features(pa.array(["AB AB | x!!\n\nok fine.\nok fine.", None, "é"]))
    f = {n: x[:, i] for i, n in enumerate(quality.FEATURES)}
    assert bounds.tolist() == [0, 4, 5, 6] and weight.tolist() == [12, 1, 9, 9, 1, 3]
    assert f["again"].tolist() == [0, 0, 0, 1, 0, 0] and f["empty"].tolist() == [0, 1, 0, 0, 1, 0]
    assert f["same"][0] == 0.25 and f["distinct"][0] == 0.75 and f["piped"][0] == 0.25 and f["marked"][0] == 0.25 and f["upper"][0] == 0.8
    near = quality.with_neighbours(x, bounds)
    assert near[5, len(quality.FEATURES) :].any() == False and near[1, len(quality.FEATURES) + 1] == x[0, 1]


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return quality.fit(docs, quality.learnable(labels))


def test_held_out_accuracy(spark, model):
    d = "/root/testdata/sf0.1"
    held = spark.read.parquet(f"{d}/labels.parquet").subtract(quality.learnable(spark.read.parquet(f"{d}/labels.parquet")))
    got = quality.score(spark.read.parquet(f"{d}/documents.parquet").join(held, "doc_id").select("doc_id", "text", "quality"), model).collect()
    right = [(r.score >= quality.THRESHOLD) == (r.quality == 1) for r in got]
    assert len(got) > 700 and np.mean(right) > 0.98
    assert all(r.score >= quality.THRESHOLD for r in got if r.quality == 1)


def test_odd_rows(spark, model):
    rows = [(1, None), (1, ""), (None, "\n\n"), (3, "Good words " * 30_000), (3, "x" * 100_000), (4, "a\n" * 3000)]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, score string, label int")
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    one_class = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, quality int")
    assert quality.fit(docs, one_class) == {"share": 1.0} and quality.fit(docs, one_class.limit(0)) == {"share": 0.5}
    assert {r.score for r in quality.score(docs, {"share": 0.5}).collect()} == {0.5}
