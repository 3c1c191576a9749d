import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlink.functions import names
from rosterlink.functions.draws import uniform
from rosterlink.functions.similarity import Choices, pair_ratio, partial_ratio, token_sorted


def column(spark, values, make):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(make(F.col("x"))).collect()]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = row[:]
        for j, d in enumerate(b):
            row[j + 1] = last[j] + 1 if c == d else max(last[j + 1], row[j])
    return row[-1]


def simple_ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


words = st.text(alphabet="abcdé ñz&", max_size=150)


@settings(max_examples=150, deadline=None)
@given(words, st.lists(words, min_size=1, max_size=8), st.integers(1, 4))
def test_scores_bounds_and_pruning(query, texts, k):
    held = Choices(texts)
    want = [simple_ratio(query, t) for t in texts]
    assert held.scores(query, held.sizes.argsort()).tolist() == pytest.approx([want[i] for i in held.sizes.argsort()])
    assert all(b >= w - 1e-9 for b, w in zip(held.bounds(query), want))
    rows, scores = held.best(query, k)
    least = sorted(want)[-min(k, len(want))]
    assert sorted(rows.tolist()) == [i for i, w in enumerate(want) if w >= least - 1e-9]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=14))
def test_partial_ratio(a, b):
    short, long = sorted((a, b), key=len)
    windows = {long[max(0, i) : i + len(short)] for i in range(1 - len(short), len(long))} if short else {""}
    want = max((simple_ratio(short, w) for w in windows), default=0.0) if short else (0.0 if long else 100.0)
    if len(a) == len(b) and a:
        want = max(want, *(simple_ratio(long, short[max(0, i) : i + len(a)]) for i in range(1 - len(a), len(a))))
    assert partial_ratio(a, b) == pytest.approx(want)
    assert pair_ratio(a, b) == pytest.approx(simple_ratio(a, b))


def test_endings(spark):
    zero = F.lit(0.0)
    made = column(spark, ["Foo Limited Liability Company", "Zinc", "Foo, Inc.", "None", "Acme, , Group", None], lambda c: names.swapped(c, zero, zero))
    assert made == ["Foo Limited Liability Co.", "Z Inc.", "Foo Inc", "None", "Acme Group", None]
    bare = column(spark, ["Foo, Inc.", "Foo, L.L.C.", "Foo, Company", "Foo,LP x", "Foo, n.v. Bar"], names.without_comma)
    assert bare == ["Foo Inc.", "Foo, L.L.C.", "Foo, Company", "Foo LP x", "Foo, n.v. Bar"]
    assert column(spark, ["coca-cola o'neil 3m", "", "ÉCOLE d'été"], names.title) == ["Coca-Cola O'Neil 3M", "", "École D'Été"]


def reference_form(x):
    for rule in names.NOISE_RULES:
        x = re.sub(rule, "", x, flags=re.I)
    x = x.strip().lower().strip()
    for rule, to in names.SUFFIX_RULES:
        x = re.sub(rule, to, x, flags=re.I)
    return x.strip()


def test_cleaning(spark):
    texts = [w.replace("{name}", n) for w in names.WRAPPERS for n in ("Apple, Inc.", "A and B Company", "X & Y L.P.", "Foo Public Limited Company", " Bar Group\t", "Zed S.A. Holdings.", "U.S. Ban, Corp")]
    assert column(spark, texts, names.lookup_form) == [reference_form(t) for t in texts]
    plain = lambda t: re.sub(r"\s+", " ", t.lower().strip().replace(",", "").replace(".", "").replace(" & ", " and "))
    assert column(spark, texts, names.basic_form) == [plain(t) for t in texts]
    assert column(spark, ["b  a\tc", " x ", ""], token_sorted) == ["a b c", "x", ""]


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(400).select("id", uniform("s", F.col("id")).alias("u"), uniform("t", F.col("id")).alias("v"))
    one, two = rows.repartition(1).orderBy("id").collect(), rows.repartition(7).orderBy("id").collect()
    assert one == two and all(0 <= r.u < 1 for r in one) and len({r.u for r in one}) == 400 and sum(r.u < r.v for r in one) not in (0, 400)
