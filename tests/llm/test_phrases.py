"""Against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rosterlink.llm import phrases

SMALL = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute(rows, least, longest=5, most=2000):
    found, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(SMALL)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, f in found.items():
        several = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in several.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) for q in [p[i : i + k]] if 100 * a >= 100 * several[q]}
        rows = []
        for p, a in several.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words, gaps = ["a", "B", "ça", "名", "d\x01", "é", "\x85x", "q"], [" ", " ", "\t", "  ", ". ", ", ", "\n", " a b ça d "]
    rows = [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None, "und"])) for _ in range(300)]
    return rows + [(None, "en"), ("", "fr"), ("a " * 450, "en"), ("A", "x"), ("...", "y"), ("p q r s t u " * 7, "z")]


@pytest.mark.parametrize(("least", "shard", "chunk"), [(5, 200, 64), (20, 1 << 20, 1 << 17), (2, 50, 16)])
def test_against_brute_force(spark, rows, monkeypatch, least, shard, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, word string").repartition(6)
    got = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(docs, least, most=150, shard_tokens=shard).collect()}
    assert got == brute(rows, least, most=150)


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "x"), (". .", "x")], "text string, lang string")).collect() == []


def test_bitmaps_over_blocks():
    """Occurrences at every place of a block, and over its end."""
    placed = np.array([0, *([7, 8] * 40), 0, 9, 7, 8, 9], np.int32)
    maps = phrases.Bitmaps(placed)
    keys, counts = phrases.pairs_in(maps)
    assert {(int(k >> 32), int(k & 0xFFFFFFFF)): int(n) for k, n in zip(keys, counts, strict=True)} == {(7, 8): 41, (8, 7): 39, (9, 7): 1, (8, 9): 1}
    found, ones = phrases.longer_in(maps, np.sort(keys), 5)
    assert {tuple(map(int, w)): int(n) for w, n in zip(found, ones, strict=True)}[(7, 8, 7, 8, 7)] == 38
