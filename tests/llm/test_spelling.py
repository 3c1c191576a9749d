"""Against brute force over all deletions, as strings."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rosterlink.llm import spelling

SMALL = {chr(65 + i): chr(97 + i) for i in range(26)}


def brute(rows, every=31, least=7, twice=2, times=10):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(SMALL.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if every and h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if n >= twice and len(w) >= least}
    groups, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            groups[k, w[:k] + w[k + 1 :]].add(w)
    for (_, cut), members in groups.items():
        for w in members:
            near[w] |= members - {w}
            if cut in words:
                near[w].add(cut)
                near[cut].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= times * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def rows_of(found):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.fixture(scope="module")
def texts():
    rng, letters = random.Random(2), "abcÀéÿ"
    base = ["".join(rng.choices(letters, k=rng.randint(7, 9))) for _ in range(40)]

    def changed(w):
        k, way = rng.randrange(len(w)), rng.randrange(3)
        return w[:k] + w[k + 1 :] if way == 0 else w[:k] + rng.choice(letters) + w[k + (way == 1) :]

    texts = []
    for _ in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 1, 1, 2, 3])):
                w = changed(w)
            words.append(w.upper() if rng.random() < 0.2 else w)
        texts.append(rng.choice([" ", "-", "×", "1", "ñ ", "Ā"]).join(words))
    long = "q" * 300 + "xyz" * 50
    texts += [None, "", "a", " ".join("q" * n for n in (127, 128, 129))] * 3 + [f"{long} {long[:-1]} {long[:100]}z{long[101:]}"] * 3 + ["é" * 20_000 + " " + "é" * 20_001] * 2
    steps = ["wandern", "wandernn", "wandernnd", "wandernndd"]  # forms of forms
    texts += [" ".join([w] * n) for w, n in zip(steps, (3000, 300, 30, 3), strict=True)]
    return [(None if i % 50 == 3 else i // 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("every", [31, None, 3])
def test_against_brute_force(spark, texts, every):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n long, word string").repartition(5)
    want = brute(texts, every)
    assert rows_of(spelling.variants(docs, every)) == want
    assert every == 3 or any(form is not None and root != form for _, form, root, *_ in want)


def test_empty_and_ties(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "strasse " * 2 + "strassa " * 20 + "strassb " * 20), (1, None)]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), None)) == brute(rows, None)


def test_equal_hashes_are_compared(monkeypatch):
    """With one key for everything, groups come from the strings alone."""
    words = ["abcdefg", "abcdefh", "abcdef", "xbcdefg", "zzzzzzz"]
    table = spelling.deletion_keys(pa.array(words))
    rows = pa.table({"key": pa.array(np.zeros(len(table[0]), np.int64)), "kind": pa.array(table[2]), "at": pa.array(table[3]), "word": pa.array(words).take(pa.array(table[1])), "n": pa.array(table[1])})
    near = Counter()
    for r in spelling.partners(rows).to_pylist():
        near[r["word"]] += r["n_near"]
    assert near == {"abcdefg": 3, "abcdefh": 2, "abcdef": 2, "xbcdefg": 1}
