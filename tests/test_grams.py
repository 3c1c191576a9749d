"""The index over pairs of characters against all pairs of texts, and windows against their strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlink.functions import similarity
from rosterlink.functions.similarity import Choices, pair_ratios, partial_ratios, sort_tokens
from rosterlink.operators import grams, lookup, search


def some(rng, letters, n):
    return ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 5, 8, 13, 20, 30]))) for _ in range(n)]


@pytest.mark.parametrize(("letters", "threshold", "block"), [("ab", 80.0, 1 << 14), ("ab cd", 90.0, 7), ("abcdefgh ", 80.0, 50), ("aé", 70.0, 1 << 14), ("abc", 60.0, 100), ("ab", 100.0, 100)])
def test_nothing_is_lost(spark, monkeypatch, letters, threshold, block):
    rng = random.Random(len(letters) + block)
    texts, queries = some(rng, letters, 250), some(rng, letters, 60)
    for _ in range(40):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            if w and rng.random() < 0.5:
                w.pop(rng.randrange(len(w)))
            else:
                w.insert(rng.randint(0, len(w)), rng.choice(letters))
        queries.append("".join(w))
    monkeypatch.setattr(grams, "CHOICE_BLOCK", block)
    monkeypatch.setattr(grams, "QUERY_BLOCK", block)
    asked = spark.createDataFrame(list(enumerate(queries)), "row long, query string")
    choices = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "ord long, kind int, nth int, text string")
    scores = pair_ratios([q for q in queries for _ in texts], [t for _ in queries for t in texts]).reshape(len(queries), -1)
    want = {(int(i), int(j)): float(scores[i, j]) for i, j in zip(*np.nonzero(scores >= threshold), strict=True)}
    for index_from in (0.0, 1000.0):  # by the index, and in blocks
        rows = search.scored_above(asked, choices, threshold, index_from).collect()
        assert {(r.row, r.ord): r.score for r in rows} == want and len(rows) == len(want)


def test_few_pairs_are_scored(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(sorted(rng.choices(words, k=5))) for _ in range(3000)]
    queries = texts[:100] + [t[:7] + t[8:] for t in texts[100:200]]
    asked = spark.createDataFrame(list(enumerate(queries)), "row long, query string")
    choices = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "ord long, kind int, nth int, text string")
    n = grams.within(asked, choices, 90.0, counting=True).agg(F.sum("counted").alias("counted"), F.sum("scored").alias("scored")).first()
    assert n.counted < 0.5 * len(queries) * len(texts) and n.scored < 0.005 * len(queries) * len(texts)
    rows = search.scored_above(asked, choices, 90.0, 0.0).collect()
    assert {i for i in range(200)} == {r.row for r in rows if r.row == r.ord}


def test_two_rounds(spark, monkeypatch):
    """The best of each query as from all blocks, and most pairs of a query and a block are never brought together."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) for _ in range(60)]
    texts = [" ".join(sorted(rng.choices(words, k=rng.choice([1, 2, 4, 8, 16, 30])))) for _ in range(1500)] + ["", "", "q" * 500]
    queries = [t[:4] + t[5:] for t in rng.choices(texts, k=50)] + ["", "zz", texts[0], "q" * 490]
    monkeypatch.setattr(search, "CHOICE_BLOCK", 60)
    asked = spark.createDataFrame([(i * 3, q) for i, q in enumerate(queries)], "row long, query string")
    choices = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "ord long, kind int, nth int, text string")
    scores = pair_ratios([q for q in queries for _ in texts], [t for _ in queries for t in texts]).reshape(len(queries), -1)
    found, routes = search.in_two_rounds(asked, choices, 4)
    got = {}
    for r in found.collect():
        assert (r.row, r.ord) not in got
        got[r.row, r.ord] = r.score
    for i in range(len(queries)):
        kth = np.sort(scores[i])[-4]
        best = {int(j): float(scores[i, j]) for j in np.flatnonzero(scores[i] >= kth)}
        mine = {o: s for (row, o), s in got.items() if row == 3 * i}
        assert best.items() <= mine.items() and all(s == scores[i, o] for o, s in mine.items())
    met = routes.agg(F.sum(F.size("cbs"))).first()[0]
    assert met < 0.6 * len(queries) * (len(texts) / 60)
    assert search.scored(asked.limit(0), choices, 4).count() == 0


@pytest.mark.parametrize("way", ["top", "partial", "above"])
def test_different_texts_meet_once(spark, monkeypatch, way):
    """Copies of queries and of names bring no more texts together, and each copy has its own rows in the result."""
    met, pairs = [], search.block_pairs

    def counted(queries, choices, task):
        met.append((queries.count(), choices.count()))
        return pairs(queries, choices, task)

    monkeypatch.setattr(search, "block_pairs", counted)
    names = ["large ring inc", "large rings inc", "hot bolt llc", "cold plate"]
    registry = spark.createDataFrame([(i, names[i % 4], ["old gear"] if i % 2 else []) for i in range(40)], "ord long, name string, former_names array<string>")
    asked = ["large ring inc", "hot bolts llc", "old gear"]
    queries = spark.createDataFrame([(q, asked[q % 3]) for q in range(9)], "qid long, query string")
    own = lambda o: [names[o % 4]] + ["old gear"] * (o % 2)
    score = lambda q, o: max(pair_ratios([sort_tokens(asked[q % 3])] * len(own(o)), [sort_tokens(t) for t in own(o)]))
    if way == "top":
        got = [(r.qid, r["rank"], r.ord, r.score) for r in search.top_k(queries, registry, 3).collect()]
        want = [(q, n + 1, o, -s) for q in range(9) for n, (s, o) in enumerate(sorted((-score(q, o), o) for o in range(40))[:3])]
    elif way == "above":
        got = [(r.qid, r.ord, r.score) for r in search.above(queries, registry, 80.0).collect()]
        want = [(q, o, score(q, o)) for q in range(9) for o in range(40) if score(q, o) >= 80]
    else:
        got = [(r.qid, r.ord, r.kind) for r in search.best_partial(queries, lookup.fallback_choices(registry)).collect()]
        want = [(q, (0, 2, 1)[q % 3], q % 3 // 2) for q in range(9)]
    assert sorted(got) == sorted(want) and met == [(3, 5)]


def test_windows_are_tried_last(monkeypatch):
    """Rows whose common subsequence with a query rules them out have no window tried."""
    rng = random.Random(5)
    held = Choices(["".join(rng.sample("abcdefghijklmnopqrst", 20)) for _ in range(600)])
    query = "abcdefghijklmnopqrst"  # the same characters as in all of them
    tried, ratios = [], similarity.partial_ratios
    monkeypatch.setattr(similarity, "partial_ratios", lambda a, b: tried.append(len(a)) or ratios(a, b))
    rows, best = held.best_partial(query)
    every = ratios([query] * 600, held.texts)
    assert best == every.max() and rows.tolist() == np.flatnonzero(every == best).tolist() and sum(tried) < 300
    assert held.best_partial(query, best + 1)[0].tolist() == []


def test_best_of_many():
    rng = random.Random(4)
    held = Choices(["".join(rng.choices("abcdefgh ", k=rng.randint(0, 40))) for _ in range(5000)])
    for query in ("", "abc", "hgfedcba abc", "x"):
        scores = held.scores(query, np.arange(5000))
        for n in (1, 6):
            rows, found = held.best(query, n)
            assert sorted(rows.tolist()) == np.flatnonzero(scores >= np.sort(scores)[-n]).tolist() and (found == scores[rows]).all()


@pytest.mark.parametrize(("letters", "most"), [("ab", 9), ("abcde é名", 40), ("ab", 150)])
def test_windows_at_once(letters, most):
    rng = random.Random(most)
    a, b = (["".join(rng.choices(letters, k=rng.randint(0, most))) for _ in range(300)] for _ in range(2))
    patterns, windows, sizes = [], [], []
    for x, y in zip(a, b, strict=True):
        ways = [(x, y)] if len(x) < len(y) else [(y, x)] if len(y) < len(x) else [(x, y), (y, x)]
        found = [(s, w) for s, t in ways for w in {t[max(0, i) : i + len(s)] for i in range(min(0, 1 - len(s)), len(t) if s else 1)}]
        patterns, windows, sizes = patterns + [s for s, _ in found], windows + [w for _, w in found], [*sizes, len(found)]
    best = np.maximum.reduceat(pair_ratios(patterns, windows), np.cumsum(sizes) - sizes)
    assert partial_ratios(a, b).tolist() == [s if x and y else 100.0 * (x == y) for s, x, y in zip(best, a, b, strict=True)]


@pytest.mark.parametrize("marks", [1024, 0])
def test_queries_are_scored_together(monkeypatch, marks):
    """Many queries at once, with texts of several words of bits, find what all pairs one by one give; bounds of both kinds; a row may stand for several."""
    monkeypatch.setattr(similarity, "MARKS", marks)
    monkeypatch.setattr(similarity, "FIRST", 8)
    monkeypatch.setattr(similarity, "TOGETHER", 100)
    monkeypatch.setattr(similarity, "AT_ONCE", 4000)
    rng = random.Random(marks)
    texts = some(rng, "abcd é", 500) + ["", "ab" * 80, "c" * 64, "d" * 65]
    queries = ["", "xyz", "ab" * 70, "c" * 64, "d" * 129, *some(rng, "abcdx é", 40)]
    held = Choices(texts, np.array([1 + i % 3 for i in range(len(texts))]))
    every = pair_ratios([q for q in queries for _ in texts], [t for _ in queries for t in texts]).reshape(len(queries), -1)
    assert (held.bounds_of(queries) >= every - similarity.SLACK).all()
    which, rows, scores = held.best_of(queries, 7, np.full(len(queries), -1.0))
    for i, own in enumerate(every):
        kth = np.sort(np.repeat(own, held.rows))[-7]
        mine = which == i
        assert sorted(rows[mine].tolist()) == np.flatnonzero(own >= kth).tolist() and (scores[mine] == own[rows[mine]]).all()
    which, rows, scores = held.above(queries, 70.0)
    assert {(int(i), int(j)) for i, j in zip(which, rows, strict=True)} == {(int(i), int(j)) for i, j in zip(*np.nonzero(every >= 70.0), strict=True)} and len(rows) == (every >= 70.0).sum()
    assert Choices([]).best_of(queries, 3, np.full(len(queries), -1.0))[0].tolist() == [] and held.above([], 70.0)[0].tolist() == []


def test_different_names_get_their_form_once(spark, monkeypatch):
    """Copies of a registry bring no more texts to the lookup's rewrites; of equal names the last row still wins, of former ones the first."""
    written, stored = {}, lookup.stored
    monkeypatch.setattr(lookup, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    rows = [(i, ["Hot Bolt, Inc.", "Cold Plate LLC", "Old Ring"][i % 3], [None, "Red Gear Corp.", ""] if i % 2 else []) for i in range(30)] + [(99, None, ["Old Ring"])]
    table = lookup.lookup_table(spark.createDataFrame(rows, "ord long, name string, former_names array<string>"))
    assert {r.norm: r.ord for r in table.collect()} == {"hot bolt inc": 27, "cold plate llc": 28, "old ring": 29, "red gear corp": 1}
    assert written["forms"].count() == 4


@pytest.mark.parametrize("together", [1, 3, 16])
def test_texts_with_like_endings_are_scored_along_them(monkeypatch, together):
    """Where bounds leave most texts to be scored, an ending that many have is gone through once, and the results are those of all pairs one by one."""
    monkeypatch.setattr(similarity, "FIRST", 8)
    monkeypatch.setattr(similarity, "AT_ONCE", 4000)
    monkeypatch.setattr(similarity, "BESIDE", together)
    rng = random.Random(together)
    texts = list(dict.fromkeys(a + b for a in some(rng, "abé", 80) for b in ("", " brand corp", " new brand corp", "c" * 70))) + [""]
    queries = ["", "xyz", "ab brand corp", "c" * 64, "dc" * 65, *some(rng, "abcx é", 40)]
    held, pairs, scores_of = Choices(texts, np.array([1 + i % 3 for i in range(len(texts))])), [], Choices.scores_of
    monkeypatch.setattr(Choices, "scores_of", lambda self, asked, which, rows: pairs.append(len(rows)) or scores_of(self, asked, which, rows))
    assert sum(len(level[0]) for level in held.tree) == len({t[i:] for t in texts for i in range(len(t))})
    every = pair_ratios([q for q in queries for _ in texts], [t for _ in queries for t in texts]).reshape(len(queries), -1)
    assert (held.all_scores(queries) == every).all()
    monkeypatch.setattr(similarity, "STEPS", 1 << 20)
    which, rows, scores = held.best_of(queries, 7, np.full(len(queries), 20.0))
    for i, own in enumerate(every):
        kth = max(20.0, np.sort(np.repeat(own, held.rows))[-7])
        mine = which == i
        assert sorted(rows[mine].tolist()) == np.flatnonzero(own >= kth).tolist() and (scores[mine] == own[rows[mine]]).all()
    which, rows, scores = held.above(queries, 30.0)
    assert sorted(zip(which.tolist(), rows.tolist(), scores.tolist(), strict=True)) == [(i, j, every[i, j]) for i, j in zip(*(x.tolist() for x in np.nonzero(every >= 30.0)), strict=True)]
    assert sum(pairs) < every.size / 4
    monkeypatch.setattr(similarity, "CELLS", 0)
    assert Choices(texts).tree is None and len(Choices(texts).above(queries, 30.0)[0]) == len(rows)


def test_digits_are_not_counted_as_letters():
    """A bound counts the characters of ASCII one by one."""
    assert Choices(["11 44 blue", "pp tt blue"]).bounds_of(["11 44 blue"])[0].tolist() == [100.0, 60.0]


@pytest.mark.parametrize("way", ["top", "former", "above", "cascade"])
def test_different_names_are_formed_once_for_a_search(spark, monkeypatch, way):
    """Copies of a registry bring no more texts to the forms that are searched; of the rows that have one, those first in order come back."""
    written, stored = {}, search.stored
    monkeypatch.setattr(search, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    names = ["Hot Bolt, Inc.", "hot bolt inc", None, "Cold  Plate"]
    registry = spark.createDataFrame([(i, names[i % 4], [None, "", "Inc Bolt"] if i % 3 == 0 else []) for i in range(48)], "ord long, name string, former_names array<string>")
    queries = spark.createDataFrame([(1, "bolt hot inc")], "qid long, query string")
    if way == "top":
        got = [(r.ord, r.score) for r in search.top_k(queries, registry, 30).orderBy("rank").collect()]
        assert got[:24] == [(i, 100.0) for i in range(48) if i % 4 < 2] and [o for o, _ in got[24:]] == [i for i in range(48) if i % 3 == 0 and i % 4 > 1][:6] and written["forms"].count() == 4
    elif way == "former":
        got = [(r.ord, r.score) for r in search.top_k_all_former(queries, registry, 3).orderBy("rank").collect()]
        assert got == [(1, 100.0), (5, 100.0), (9, 100.0)] and written["forms"].count() == 4
    elif way == "above":
        assert sorted(r.ord for r in search.above(queries, registry, 99.0).collect()) == [i for i in range(48) if i % 4 < 2]
        assert written["classes"].count() == 7 and all(len(r.forms) <= 2 for r in written["classes"].collect())
    else:
        assert [r.ord for r in lookup.cascade(queries, registry, scorers=("token_sort",)).collect()] == [1] and written["forms"].count() == 4


def test_only_queries_that_leave_much_are_scored_along_the_tree(monkeypatch):
    """Of the queries of one batch those whose bounds leave few texts are scored pair by pair, and the results are those of all pairs."""
    monkeypatch.setattr(similarity, "STEPS", 60)
    rng = random.Random(8)
    texts = list(dict.fromkeys("".join(rng.sample("abcdefghij", 10)) + " brand corp" for _ in range(900))) + [f"{k} klmnopq" * 2 for k in range(100, 140)]
    hard = ["jihgfedcba brand corp", "acegibdfhj brand corp", "bdfhjacegi brand corp"]
    queries = [*texts[-20:], "klmnopq", *hard]
    held, through, all_scores = Choices(texts), [], Choices.all_scores
    monkeypatch.setattr(Choices, "all_scores", lambda self, asked: through.extend(asked) or all_scores(self, asked))
    assert held.clipped.dtype == np.uint8
    every = pair_ratios([q for q in queries for _ in texts], [t for _ in queries for t in texts]).reshape(len(queries), -1)
    which, rows, scores = held.best_of(queries, 6, np.full(len(queries), -1.0))
    want = [(i, j, own[j]) for i, own in enumerate(every) for j in np.flatnonzero(own >= np.sort(own)[-6])]
    assert sorted(zip(which.tolist(), rows.tolist(), scores.tolist(), strict=True)) == want and through == hard
    through.clear()
    which, rows, scores = held.above(queries, 60.0)
    assert sorted(zip(which.tolist(), rows.tolist(), scores.tolist(), strict=True)) == [(i, j, every[i, j]) for i, j in zip(*np.nonzero(every >= 60.0), strict=True)] and through == hard


@pytest.mark.parametrize("slots", [1 << 20, 0])
def test_windows_end_with_their_pattern(monkeypatch, slots):
    """Windows at the ends of a text come from two passes over it, and a window takes as many steps as its pattern has characters, however long others of the batch are."""
    monkeypatch.setattr(similarity, "SLOTS", slots)
    rng, steps, advance = random.Random(6), [], similarity.advance
    a = ["".join(rng.choices("abc é", k=k)) for k in (1, 2, 3, 40, 64, 70, 130)]
    b = ["".join(rng.choices("abc é", k=len(x) + more)) for x, more in zip(a, (0, 1, 2, 9, 30, 9, 9), strict=True)]
    monkeypatch.setattr(similarity, "advance", lambda state, masks: steps.append(state.shape[1]) or advance(state, masks))
    best = similarity.windows(a, b)
    assert sum(steps) == sum(len(x) * (2 + max(0, len(y) - len(x) - 1)) for x, y in zip(a, b, strict=True))
    for x, y, own in zip(a, b, best.tolist(), strict=True):
        every = [y[max(0, i) : i + len(x)] for i in range(1 - len(x), len(y))]
        assert own == pair_ratios([x] * len(every), every).max()
