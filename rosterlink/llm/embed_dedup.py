"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

A label of more than PARTED_FROM blocks' vectors is parted into cells: the top levels of a cover tree over a sample of it (SAMPLE vectors, about) give centres, MOST_CELLS at most, and every vector is
at home in the cell of its nearest centre.  If it is linked with a vector of another cell, that cell's centre is at most twice the threshold distance farther away than its
own; so it visits only such cells, and of two cells the vectors of the later one visit the earlier.  All other pairs of cells are never brought together.  Where vectors are
all about equally far from all centres that is each pair of cells, as many rows as if nothing was parted.

A cell's vectors and its visitors are dealt into blocks by a hash of their id, so that the largest block is bounded however large a
cell is.  Every two blocks of vectors at home (and each block with itself), and each of those with each block of visitors, meet in one task, as two cover trees.  In a cover tree
the nodes of a level lie in balls of half the radius of the level above; each node keeps the true distance of its farthest vector.
A pair of nodes is dropped when their centres are farther apart than both radii and the threshold distance, taken whole (links
are counted, not listed) when even their farthest vectors are within it, and opened otherwise.

A task returns, for each vector, its number of links there and one edge towards the smallest vector of its local component: rows grow with
vectors, not with links.  Counts are summed, components are found over the edges.

Labels must be equal and not null.  Vectors that are null, empty, zero, or hold a null or a non-finite component link with nothing, nor do
vectors of different lengths.  Repeated rows are vectors of their own (a row without an id comes last); equal vectors are linked.
Other columns are dropped, so their names cannot clash.  An empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, stored, unique_ids

BLOCK = 4096
LEAF = 24
TOP_RADIUS = 2.0
SLACK = 1e-7
CHUNK = 1024
SAMPLE, MOST_CELLS = 4096, 256
PARTED_FROM = 4


class CoverTree:
    """Over unit vectors.  Node i covers members order[low[i]:high[i]]; its children are nodes first[i]:last[i] (none: a leaf)."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        n = len(unit)
        self.order = np.arange(n)
        self.centre, self.radius, self.low, self.high, self.first, self.last, level = [], [], [], [], [], [], []

        def add(centre: int, radius: float, a: int, b: int, at: float) -> None:
            for values, x in ((self.centre, centre), (self.radius, radius), (self.low, a), (self.high, b), (self.first, 0), (self.last, 0), (level, at)):
                values.append(x)

        if n:
            far = distances(unit[:1], unit)[0]
            add(0, float(far.max()), 0, n, TOP_RADIUS)
        k = 0
        while k < len(self.centre):
            a, b, at = self.low[k], self.high[k], level[k]
            if b - a > LEAF and self.radius[k] > 1e-6:
                while at >= self.radius[k]:
                    at /= 2  # levels on which this node is its own only child
                self.first[k] = len(self.centre)
                for centre, members, radius in self.balls(self.order[a:b].copy(), at):
                    self.order[a : a + len(members)] = members
                    add(centre, radius, a, a + len(members), at)
                    a += len(members)
                self.last[k] = len(self.centre)
            k += 1
        self.centre, self.radius, self.low, self.high, self.first, self.last = (np.array(x) for x in (self.centre, self.radius, self.low, self.high, self.first, self.last))

    def balls(self, members: np.ndarray, radius: float) -> Iterator[tuple[int, np.ndarray, float]]:
        """Balls of so small a radius, around members, that cover all of them; no centre lies in an earlier ball."""
        vectors = self.unit[members]
        while len(members):
            d = distances(vectors[:64], vectors)
            taken = np.full(len(members), -1)
            apart = np.full(len(members), np.inf)
            for i in range(min(64, len(members))):
                if taken[i] >= 0:
                    continue
                near = (d[i] <= radius) & (taken < 0)
                near[i] = True
                taken[near], apart[near] = i, d[i][near]
            for i in np.unique(taken[taken >= 0]):
                mine = taken == i
                yield int(members[i]), members[mine], float(apart[mine].max())
            rest = taken < 0
            members, vectors = members[rest], vectors[rest]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class Links:
    """Counts of links and local components, for the vectors of two trees (or one)."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.n, self.parent = ids, np.zeros(len(ids), np.int64), np.arange(len(ids))
        self.by_rank = np.argsort(ids, kind="stable")
        self.rank = np.empty(len(ids), np.int64)
        self.rank[self.by_rank] = np.arange(len(ids))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return int(i)

    def union(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins x[k] with y[k] for all k: each root goes under the smallest root that it is joined with, until no two are apart."""
        while len(x):
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up
            a, b = self.rank[self.parent[x]], self.rank[self.parent[y]]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            least = np.arange(len(self.ids))
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            moved = np.flatnonzero(least < np.arange(len(self.ids)))
            self.parent[self.by_rank[moved]] = self.by_rank[least[moved]]


def dual_traversal(one: CoverTree, two: CoverTree, base: int, same: bool, cosine: float, links: Links) -> None:
    """Counts all pairs of cosine or more between the two trees (within the tree, if same)."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    if not len(one.centre) or not len(two.centre):
        return
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        kids_a = np.arange(one.first[a], one.last[a]) if one.last[a] else None
        kids_b = np.arange(two.first[b], two.last[b]) if two.last[b] else None
        if (kids_a is None and kids_b is None) or (one.high[a] - one.low[a]) * (two.high[b] - two.low[b]) <= LEAF * LEAF:
            compare(one, one.order[one.low[a] : one.high[a]], two, two.order[two.low[b] : two.high[b]], base, same and a == b, cosine, links)
            continue
        kids_a, kids_b = np.array([a]) if kids_a is None else kids_a, np.array([b]) if kids_b is None else kids_b
        for at in range(0, len(kids_a), CHUNK):
            x = kids_a[at : at + CHUNK]
            for bt in range(0, len(kids_b), CHUNK):
                y = kids_b[bt : bt + CHUNK]
                alike = one.unit[one.centre[x]] @ two.unit[two.centre[y]].T
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * alike))
                both = one.radius[x][:, None] + two.radius[y][None, :]
                alive = d <= both + reach + SLACK
                if same and a == b:
                    alive &= x[:, None] <= y[None, :]
                single = (one.high[x] - one.low[x] == 1)[:, None] & (two.high[y] - two.low[y] == 1)[None, :]  # nodes of one vector each are their centres
                if single.any():
                    i, j = np.nonzero(alive & single & (alike >= cosine) & ((x[:, None] != y[None, :]) | (not same)))
                    if len(i):
                        s, t = one.centre[x[i]], two.centre[y[j]] + base
                        np.add.at(links.n, s, 1)
                        np.add.at(links.n, t, 1)
                        links.union(s, t)
                i, j = np.nonzero(alive & ~single)
                whole = (d[i, j] + both[i, j] <= reach - SLACK) & (~(x[i] == y[j]) if same and a == b else True)
                for p, q in zip(x[i[whole]], y[j[whole]], strict=True):
                    s, t = one.order[one.low[p] : one.high[p]], two.order[two.low[q] : two.high[q]] + base
                    links.n[s] += len(t)
                    links.n[t] += len(s)
                    links.union(np.concatenate([s, t]), np.concatenate([np.full(len(s), t[0]), np.full(len(t), s[0])]))
                stack += zip(x[i[~whole]].tolist(), y[j[~whole]].tolist(), strict=True)


def compare(one: CoverTree, s: np.ndarray, two: CoverTree, t: np.ndarray, base: int, same: bool, cosine: float, links: Links) -> None:
    for at in range(0, len(s), CHUNK):
        for bt in range(0, len(t), CHUNK):
            found = one.unit[s[at : at + CHUNK]] @ two.unit[t[bt : bt + CHUNK]].T >= cosine
            if same:
                found &= (np.arange(at, at + found.shape[0])[:, None] < np.arange(bt, bt + found.shape[1])[None, :])
            i, j = np.nonzero(found)
            if len(i):
                x, y = s[at + i], t[bt + j] + base
                np.add.at(links.n, x, 1)
                np.add.at(links.n, y, 1)
                links.union(x, y)


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(rid, label, embedding) -> (rid, label, unit binary): only vectors that can link; doubles divided by their norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, keep, out = batch.column(2), [], []
            starts, values = vectors.offsets.to_numpy(), vectors.values
            flat, null = values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.is_null().to_numpy(zero_copy_only=False)
            for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False)):
                x = flat[a:b]
                if null[k] or not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()  # no overflow in the norm
                keep.append(k)
                out.append((x / np.sqrt(x @ x)).tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["rid", "label", "unit"])

    return rows.mapInArrow(run, f"rid long, label {rows.schema['label'].dataType.simpleString()}, unit binary")


def top_centres(unit: np.ndarray, wanted: int) -> np.ndarray:
    """Centres of the nodes of a cover tree's top levels: the largest nodes are opened until there are as many as wanted (at most: the largest of them)."""
    tree = CoverTree(unit)
    nodes = [0] if len(unit) else []
    while len(nodes) < wanted:
        size, node = max(((tree.high[k] - tree.low[k], k) for k in nodes if tree.last[k]), default=(0, None))
        if node is None:
            break
        nodes = [k for k in nodes if k != node] + list(range(tree.first[node], tree.last[node]))
    nodes = sorted(nodes, key=lambda k: (tree.low[k] - tree.high[k], k))[:wanted]
    return unit[np.unique(tree.centre[nodes])] if nodes else unit[:0]


def in_cells(units: DataFrame, cosine: float, block: int, sample: int = SAMPLE, most: int = MOST_CELLS) -> DataFrame:
    """(rid, label, size, unit) -> and home int, visits array<int>: the cell that each vector is at home in, and the earlier ones that it has to visit."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))
    sizes = units.groupBy("label", "size").agg(F.count(F.lit(1)).alias("rows"))
    large = stored(sizes.filter(F.col("rows") > PARTED_FROM * block).withColumn("parts", F.ceil(F.col("rows") / block).cast("int")), "large")
    kind = units.schema["label"].dataType.simpleString()

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        found = top_centres(unit, min(most, table["parts"][0].as_py()))
        return pa.table({"label": table["label"].slice(0, 1), "size": table["size"].slice(0, 1), "centres": pa.array([found.tobytes()], pa.binary())})

    def homes(left: pa.Table, right: pa.Table) -> pa.Table:
        unit = np.frombuffer(b"".join(left["unit"].to_pylist()), np.float64).reshape(left.num_rows, -1)
        found = np.frombuffer(right["centres"][0].as_py() if right.num_rows else b"", np.float64).reshape(-1, unit.shape[1])
        if not len(found):
            found = unit[:1] * 0.0  # no sample: one cell
        d = distances(unit, found)
        home = d.argmin(axis=1)
        near = d <= d[np.arange(len(d)), home][:, None] + 2 * reach + SLACK
        near &= np.arange(len(found))[None, :] < home[:, None]
        visits = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(near.sum(axis=1))], pa.int32()), pa.array(np.nonzero(near)[1], pa.int32()))
        return pa.table({"rid": left["rid"], "label": left["label"], "size": left["size"], "unit": left["unit"], "home": pa.array(home, pa.int32()), "visits": visits})

    drawn = units.join(large, ["label", "size"]).filter(F.pmod(F.xxhash64("rid", F.lit("sample")), F.col("rows")) < sample).select("rid", "label", "size", "unit", "parts")
    found = stored(drawn.groupBy("label", "size").applyInArrow(centres, f"label {kind}, size int, centres binary"), "centres")
    part = units.join(large, ["label", "size"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).select("label", "size", "part", "rid", "unit")
    copies = large.join(found, ["label", "size"]).select("label", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "centres")
    placed = part.groupBy("label", "size", "part").cogroup(copies.groupBy("label", "size", "part")).applyInArrow(homes, f"rid long, label {kind}, size int, unit binary, home int, visits array<int>")
    small = units.join(large, ["label", "size"], "left_anti").select("rid", "label", "size", "unit", F.lit(0).alias("home"), F.array().cast("array<int>").alias("visits"))
    return small.unionByName(placed)


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vectors -> (id_col, n_links, component_id, kept): links are pairs of the same label with cosine or more."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows, plain = unique_ids(vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")), "vec_id")
    units = stored(unit_vectors(rows.filter("label is not null").select("rid", "label", "embedding")).withColumn("size", F.length("unit")), "units")
    cells = stored(in_cells(units, cosine, block), "cells")
    there = F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(False).alias("visitor"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("visitor")))))
    there = cells.select("label", "size", "rid", "unit", there.alias("x")).select("label", "size", "x.cell", "x.visitor", "rid", "unit")
    where = ["label", "size", "cell"]
    blocks = there.groupBy(*where).agg(F.ceil(F.count_if(~F.col("visitor")) / block).cast("int").alias("hosts"), F.ceil(F.count_if("visitor") / block).cast("int").alias("guests"))
    dealt = there.join(blocks.filter("hosts > 0"), where)  # a cell's blocks: those of vectors at home first
    own = F.when(F.col("visitor"), F.col("hosts") + F.pmod(F.xxhash64("rid"), F.col("guests"))).otherwise(F.pmod(F.xxhash64("rid"), F.col("hosts"))).cast("int")
    last = F.when(F.col("visitor"), F.col("hosts")).otherwise(F.col("hosts") + F.col("guests")) - 1  # visitors don't meet each other
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    met = met.select(*where, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "rid", "unit")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("rid")
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        own, ids = table["own"].to_numpy(), table["rid"].to_numpy()
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(ids), -1)
        first, second = np.flatnonzero(own == one), np.flatnonzero(own == two)
        place = first if one == two else np.concatenate([first, second])
        links = Links(ids[place])
        tree = CoverTree(unit[first])
        other = tree if one == two else CoverTree(unit[second])
        dual_traversal(tree, other, 0 if one == two else len(first), one == two, cosine, links)
        roots = ids[place][[links.root(i) for i in range(len(place))]] if len(place) else ids[place]
        some = links.n > 0
        return pa.table({"rid": ids[place][some], "n": links.n[some], "root": roots[some]})

    found = stored(met.groupBy(*where, "one", "two").applyInArrow(task, "rid long, n long, root long"), "links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    named = rows.select("rid", "vec_id").join(counts, "rid", "left").join(roots.select(F.col("id").alias("rid"), "root"), "rid", "left")
    named = named.select("rid", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rid").alias("root"))
    if plain:
        return named.select(F.col("vec_id").alias(id_col), "n_links", F.col("root").alias("component_id"), (F.col("rid") == F.col("root")).alias("kept"))
    named = named.join(rows.select(F.col("rid").alias("root"), F.col("vec_id").alias("component_id")), "root")
    return named.select(F.col("vec_id").alias(id_col), "n_links", "component_id", (F.col("rid") == F.col("root")).alias("kept"))
