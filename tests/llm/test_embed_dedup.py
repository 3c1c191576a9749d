import numpy as np
import pytest

from rosterlink.llm import embed_dedup


def brute(rows, cosine=0.98):
    usable = [i for i, (_, label, v) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][2], float) / np.linalg.norm(rows[i][2]) for i in usable}
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(usable):
        for j in usable[:k]:
            if rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                root[b] = a
    return {rows[i][0]: (n[i], rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize(("block", "sample", "most"), [(40, 4096, 256), (40, 30, 7), (10, 20, 256), (4096, 4096, 256)])
def test_against_brute_force(spark, monkeypatch, block, sample, most):
    cells = embed_dedup.in_cells
    monkeypatch.setattr(embed_dedup, "in_cells", lambda units, cosine, block: cells(units, cosine, block, sample, most))
    rng = np.random.default_rng(4)
    rows = []
    for c in range(14):
        centre = rng.normal(size=8)
        for _ in range(40):
            rows.append((len(rows) * 7 % 1009, int(rng.integers(0, 2)) if c % 2 else 1, (centre + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.4])).tolist()))
    rows += [(2001, 1, None), (2002, 1, [0.0] * 8), (2003, None, rows[0][2]), (2004, 1, [float("nan")] + [1.0] * 7), (2005, 1, [None] * 8), (2006, 1, []), (2007, 1, [1.0, 2.0]), (2008, 1, [2.0, 4.0]), (2009, 1, [1e30] * 8)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, rid string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(table, block=block).collect()}
    assert got == brute(rows)


def test_few_cells_are_visited(spark):
    """Clustered vectors stay at home; spread ones visit all earlier cells.  Every link is between vectors that meet."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    for spread, most in ((0.02, 0.1), (10.0, 30.0)):
        vectors = centres[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 32)) * spread
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        units = spark.createDataFrame([(i, 0, 256, bytearray(v.tobytes())) for i, v in enumerate(unit)], "rid long, label int, size int, unit binary")
        rows = {r.rid: (r.home, set(r.visits)) for r in embed_dedup.in_cells(units, 0.98, 50).collect()}
        assert len(rows) == 2000 and len({h for h, _ in rows.values()}) > 20
        assert sum(len(v) for _, v in rows.values()) / 2000 <= most
        for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= 0.98, 1)), strict=True):
            (h, v), (g, w) = rows[int(i)], rows[int(j)]
            assert h == g or (g in v if g < h else h in w)


def test_stored_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_vectors(table).collect()}
    assert got == {k: (n, c, k == c) for k, (n, c) in brute(rows).items()}


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (None, 0, [1.0, 0.01]), (3, 0, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_vectors(table).collect())
    assert got == [("1", 2, 1, False), ("1", 2, 1, True), ("3", 0, 3, True), ("None", 2, 1, False)]
    assert embed_dedup.near_duplicate_vectors(table.limit(0)).count() == 0


def test_nodes_hold_what_they_cover():
    rng = np.random.default_rng(1)
    unit = rng.normal(size=(900, 5)) + rng.normal(size=(1, 5)) * 2
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tree = embed_dedup.CoverTree(unit)
    assert sorted(tree.order) == list(range(900))
    for c, r, a, b, f, l in zip(tree.centre, tree.radius, tree.low, tree.high, tree.first, tree.last):
        assert embed_dedup.distances(unit[[c]], unit[tree.order[a:b]]).max() <= r + 1e-7  # the slack of the traversal
        if l:
            assert tree.low[f] == a and tree.high[l - 1] == b
