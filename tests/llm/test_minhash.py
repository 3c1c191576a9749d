import random
import re

import pyarrow as pa
import pytest

from rosterlink.llm import minhash


def brute(rows, k, percent):
    """rows: (rid, text) -> {rid: (n, root)}"""
    sets = {}
    for rid, text in rows:
        w = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[rid] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {r: r for r in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[:i]:
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {r: (len(s), find(r)) for r, s in sets.items()}


def made(seed, n=140):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    texts = ["", None, " \n ", "One", "one", "one two", "One Two", "a\x0bb c", "a b\x1cc d"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 120))]
        chain = list(base)
        for _ in range(n // 12):
            chain = list(chain if rng.random() < 0.5 else base)
            for _ in range(rng.randint(0, 3)):
                chain[rng.randrange(len(chain))] = word().upper()
            texts.append(rng.choice([" ", "\n", "\t "]).join(chain))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("k,percent,rows", [(3, 85, 5), (5, 80, 4)])
def test_against_brute_force(spark, k, percent, rows):
    texts = made(percent)
    docs = spark.createDataFrame([(i, t, 2, 3) for i, t in enumerate(texts)], "doc_id long, text string, n long, rep int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, k, percent, rows).collect()}
    assert got == brute(list(enumerate(texts)), k, percent)


def test_a_hub_of_many_pairs(spark, monkeypatch):
    """Copies of one text that differ by a word each: one hub, its pairs dealt out among copies of its text."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] + [" ".join([*base[:i], "x", *base[i + 1 :]]) for i in range(1, 59)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(minhash, "HUB_PAIRS", 4)
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 59)] + [(5, 4)], "a long, b long")
    found = minhash.verified(pairs, docs.select(docs.doc_id.alias("rid"), "text"), 3)
    sets = {i: {tuple(w[k : k + 3]) for w in [t.split()] for k in range(len(w) - 2)} for i, t in rows}
    assert {(r.a, r.b): (r.both, r.either) for r in found.collect()} == {(a, b): (len(sets[a] & sets[b]), len(sets[a] | sets[b])) for a, b in [*((i, 0) for i in range(1, 59)), (5, 4)]}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, 5).collect()}
    assert got == brute(rows, 3, 85)


def test_stored_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 3, 85, 5).collect()}
    assert got == brute(rows, 3, 85)


def test_repeated_and_missing_ids(spark):
    rows = [(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (None, "zz"), (2, "A B C D"), (7, None), (7, "x y z u v")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 5).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in found) == sorted(
        [("4", 2, "2", False), ("4", 2, "2", False), ("None", 2, "2", False), ("None", 1, "None", True), ("2", 2, "2", True), ("7", 0, "7", True), ("7", 3, "7", True)])
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_min_and_max_come_from_one_evaluation():
    (_, values, bounds), *_ = minhash.shingle_sets(pa.array(["a b c d e", "a b c d e"]), 3)
    bands = minhash.bands_of(values, bounds, 5)
    assert bands.shape == (2, 2 * minhash.PERMUTATIONS // 5) and (bands[0] == bands[1]).all() and len(set(bands[0].tolist())) == bands.shape[1]
