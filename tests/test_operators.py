import hashlib
import json
import urllib.error
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rosterlink.functions import names, similarity
from rosterlink.functions.similarity import partial_ratio, sort_tokens
from rosterlink.operators import builds, datasets, lookup, prompts, resolve, score, search, selector, splits
from rosterlink.plans import oracles as plans_sql
from rosterlink.plans import registry as plans
from rosterlink.sources import registry as sources
from rosterlink.sources import replies, sinks
from tests.test_names import simple_ratio

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entities(spark):
    return sources.entities(spark, DIR).cache()


def plain(text):
    return " ".join(text.lower().strip().replace(",", "").replace(".", "").replace(" & ", " and ").split())


def test_top_k_against_all_pairs(spark, entities, monkeypatch):
    rows = entities.orderBy("ord").collect()
    queries = plans.asked(spark, DIR).union(spark.createDataFrame([(900, "brand inc", 0, ""), (901, "", 0, ""), (902, "x" * 90, 0, "")], "qid long, query string, cik long, name string")).cache()
    choices = []
    for r in rows:
        former = [f for f in r.former_names if f]
        choices.append((r.ord, [sort_tokens(plain(r.name))] + ([sort_tokens(former[-1].lower())] if former else [])))
    want = {}
    for q in queries.collect():
        text = sort_tokens(plain(q.query))
        scored = sorted(((-max(simple_ratio(text, t) for t in ts), o) for o, ts in choices))[:3]
        want[q.qid] = [(o, round(-s, 6)) for s, o in scored]
    for block in (1 << 15, 60):
        monkeypatch.setattr(search, "CHOICE_BLOCK", block)
        got = defaultdict(list)
        for r in search.top_k(queries.select("qid", "query"), entities, 3).orderBy("qid", "rank").collect():
            got[r.qid].append((r.ord, round(r.score, 6)))
        assert got == want


def test_threshold_and_older_form(spark, entities):
    queries = plans.asked(spark, DIR).cache()
    rows = entities.collect()
    above = {(r.qid, r.ord) for r in search.above(queries, entities, 80.0).collect()}
    want, older = set(), {}
    for q in queries.collect():
        text, scored = sort_tokens(plain(q.query)), []
        for r in rows:
            former = [f for f in r.former_names if f]
            if max(simple_ratio(text, sort_tokens(t)) for t in [plain(r.name)] + [f.lower() for f in former[-1:]]) >= 80:
                want.add((q.qid, r.ord))
            scored += [(-simple_ratio(sort_tokens(q.query), sort_tokens(t)), r.ord, n) for n, t in enumerate([r.name, *former])]
        older[q.qid] = list(dict.fromkeys(o for _, o, _ in sorted(scored)[:6]))[:3]
    assert above == want
    got = defaultdict(list)
    for r in search.top_k_all_former(queries, entities, 3).orderBy("qid", "rank").collect():
        got[r.qid].append(r.ord)
    assert got == older


def test_keys_of_queries_are_the_callers(spark):
    """Null and repeated keys, and keys of another type: each query is a row of its own."""
    registry = spark.createDataFrame([(0, "Alpha Inc", []), (1, "Beta LLC", ["Old Beta"]), (2, "Gamma Co", [])], "ord long, name string, former_names array<string>")
    rows = [(None, "alpha inc"), (None, "beta llc"), ("x", "gamma co"), ("x", "gamma co"), ("x", "Betta LLC"), ("y", None)]
    queries = spark.createDataFrame(rows, "qid string, query string")
    best = Counter((r.qid, r.ord) for r in search.top_k(queries, registry, 1).collect())
    assert best == {(None, 0): 1, (None, 1): 1, ("x", 2): 2, ("x", 1): 1}
    assert Counter(r.qid for r in search.top_k(queries, registry, 2).collect()) == {None: 4, "x": 6}
    assert Counter((r.qid, r.ord) for r in search.above(queries, registry, 95.0).collect()) == {(None, 0): 1, (None, 1): 1, ("x", 2): 2}
    assert Counter((r.qid, r.ord, r.how) for r in lookup.cascade(queries, registry).collect()) == {(None, 0, "exact"): 1, (None, 1, "exact"): 1, ("x", 2, "exact"): 2, ("x", 1, "similar"): 1, ("y", None, None): 1}
    assert Counter(r.qid for r in search.best_partial(queries, lookup.fallback_choices(registry)).collect()) == {None: 2, "x": 3}


def test_cascade_is_lookup_then_similarity(spark, entities):
    queries = spark.createDataFrame([(1, "zzz"), (2, "dba Alpha, Inc."), (3, "Alpha Widgets Incorporatd"), (4, "old beta")], "qid long, query string")
    registry = spark.createDataFrame([(0, "ALPHA INC", []), (1, "Alpha Inc.", ["Old Beta"]), (2, "Alpha Widgets Incorporated", ["Old Beta", ""])], "ord long, name string, former_names array<string>")
    got = {r.qid: (r.ord, r.how) for r in lookup.cascade(queries, registry).collect()}
    assert got == {1: (None, None), 2: (1, "exact"), 3: (2, "similar"), 4: (1, "exact")}


def test_hybrid_report_is_the_whole_cascade(spark, tmp_path):
    part = spark.read.parquet(f"{DIR}/part.parquet").filter("p_partkey <= 60")
    part.withColumn("p_partkey", F.col("p_partkey") * 25).write.parquet(str(tmp_path / "part.parquet"))
    registry = sources.entities(spark, str(tmp_path)).orderBy("ord").collect()
    asked = plans.misspelt(spark, str(tmp_path)).withColumns({"norm": names.lookup_form(F.col("query")), "bare": names.without_noise(F.col("query"))}).collect()
    texts = [(r.ord, 0, r.name) for r in registry] + [(r.ord, 1, f) for r in registry for f in r.former_names if f]
    norms = {r.t: r.norm for r in spark.createDataFrame([(t,) for _, _, t in texts], "t string").select("t", names.suffix_form(F.col("t")).alias("norm")).collect()}
    table, choices, name = {}, {}, {r.ord: r.name for r in registry}
    for ord_, kind, t in texts:
        if not kind:
            table[norms[t]] = ord_
        choices[ord_, kind] = t  # of the former names the last
    for ord_, kind, t in texts:
        table.setdefault(norms[t], ord_)
    choices = sorted((kind, ord_, t) for (ord_, kind), t in choices.items())
    want, ways = Counter(), Counter()
    for q in asked:
        got = table.get(q.norm)
        how = "exact" if got is not None else "none"
        if got is None:
            best = max([(simple_ratio(sort_tokens(q.query), sort_tokens(t)), 1, -i) for i, (_, _, t) in enumerate(choices)] + [(partial_ratio(q.bare, t), 0, -i) for i, (_, _, t) in enumerate(choices)])
            if best[0] >= 80:
                got, how = choices[-best[2]][1], "similar"
        hit, bucket = got is not None and name[got] == q.name, "hard" if q.kinds >= 2 else "easy"
        ways[how, hit] += 1
        want += Counter({"n": 1, "hits": int(hit), "calls": int(got is None), bucket: 1, f"{bucket}_hits": int(hit)})
    assert ways["exact", True] and ways["similar", True]  # else a report of lookup alone would pass
    got = plans.hybrid_report_two_scorers(spark, str(tmp_path)).first().asDict()
    assert {k: got[k] for k in ("n", "hits", "calls", "hard", "easy", "hard_hits", "easy_hits")} == {k: want[k] for k in ("n", "hits", "calls", "hard", "easy", "hard_hits", "easy_hits")}
    for key, a, b in (("call_rate", "calls", "n"), ("accuracy", "hits", "n"), ("accuracy_hard", "hard_hits", "hard"), ("accuracy_easy", "easy_hits", "easy")):
        assert got[key] == round(want[a] / want[b] if want[b] else 0.0, 9)


def test_hybrid_counts(spark):
    registry = spark.createDataFrame([(0, 10, "Alpha Inc", "corp", []), (1, 11, "Beta Widgets LLC", "corp", [])], "ord long, cik long, name string, entity_type string, former_names array<string>")
    rows = [(1, "alpha incorporated", "Alpha Inc", "easy", 0), (2, "Beta Widget LLC", "Beta Widgets LLC", "hard", 1), (3, "qqq", "Beta Widgets LLC", "hard", 1), (4, "zzz", "Alpha Inc", "easy", 1), (5, None, "Alpha Inc", "easy", 0)]
    names_ = [("Alpha Inc", 10), ("Beta Widgets LLC", 11)]
    rows = spark.createDataFrame([(q, t, n, d, [(1, names_[c][1], names_[c][0].upper(), "corp", 1.0)]) for q, t, n, d, c in rows], "qid long, query string, name string, difficulty string, candidates array<struct<rank int, cik long, name string, entity_type string, score double>>")
    got = selector.hybrid(rows, registry, selector.routed("My-First-1", {"first": selector.first_candidate}, selector.rule_matcher(registry))).first().asDict()
    assert (got["n"], got["hits"], got["calls"], got["call_hits"], got["total_accuracy"], got["call_rate"], got["hard_hits"], got["easy_hits"]) == (5, 2, 3, 2, 0.8, 0.6, 1, 1)
    got = selector.hybrid(rows, registry).first()
    assert (got.hits, got.calls, got.call_hits, got.call_rate) == (2, 0, 0, 0.0)


def test_nulls_two_registries_and_clashes(spark):
    one = spark.createDataFrame([(1, "Alpha Inc", "corp", ["Old Alpha", None]), (2, None, None, []), (3, "Beta LLC", None, None)], "cik long, name string, entity_type string, former_names array<string>")
    registry = sources.with_order(one, one.withColumn("cik", F.col("cik") + 10)).cache()
    assert registry.agg(F.max("ord")).first()[0] >= 1 << 56
    queries = spark.createDataFrame([(1, None), (2, "alpha inc"), (3, ""), (4, "old alpha"), (5, "Beta LC")], "qid long, query string").withColumns({c: F.lit(c) for c in ("norm", "hit", "ord", "kind")})
    for found in (search.top_k(queries, registry, 2), search.top_k_all_former(queries, registry, 2), search.above(queries, registry, 0.0)):
        rows = found.collect()
        assert {r.qid for r in rows} == {2, 3, 4, 5}
    best = {r.qid: r.how for r in lookup.cascade(queries, registry).collect()}
    assert best == {1: None, 2: "exact", 3: best[3], 4: "exact", 5: "similar"}
    assert {r.qid for r in search.best_partial(queries, lookup.fallback_choices(registry)).collect()} == {2, 3, 4, 5}
    tried = lookup.exact(queries, registry)
    assert tried.count() == 5 and "hit" in tried.columns and len(tried.columns) == len(set(tried.columns))
    assert search.top_k(queries.limit(0), registry, 2).count() == 0 and lookup.cascade(queries, registry.limit(0)).filter("ord is not null").count() == 0
    assert datasets.retrieval_examples(registry, registry, k=2).count() > 0
    held = spark.createDataFrame([("x",), (None,)], "input string")
    rows = spark.createDataFrame([("x", 1), (None, 2), ("y", 3), ("y", 3)], "input string, hit int").withColumns({"held_input": F.lit(0), "in_test": F.lit("mine")})
    assert sorted((r.hit, r.in_test) for r in datasets.flagged(rows, held).collect()) == [(1, True), (2, False), (3, False), (3, False)]


def test_texts_that_hold_items(spark, monkeypatch):
    monkeypatch.setattr(datasets, "SHORT_ITEMS", 2)  # short items in several blocks
    texts = ["one two three four five", "xone two threey", "a\tb  c d e f", "", None, "short", "say short words", "two", "é ü ö ä ß", "one two three four five"]
    items = ["one two three", "two three", "ne two thre", "b  c d", "b c d", "short", "", None, "t", "ü ö ä", "wo three four fiv", "a\tb  c d e f", "two three four five six"]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, n int, row int")
    known = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, item string")
    want = Counter((i, j) for i, t in enumerate(texts) for j, x in enumerate(items) if t is not None and x and x in t)
    assert Counter(map(tuple, datasets.containing(docs, known).collect())) == want
    assert datasets.containing(docs, known.limit(0)).count() == 0 and datasets.containing(docs.limit(0), known).count() == 0


def test_repeated_ciks_have_examples_of_their_own(spark):
    rows = [(0, 1, "Alpha Inc", "a", ["Old Alpha"]), (1, 2, "Beta LLC", "b", []), (2, 2, "Beta LLC", "b", []), (3, 3, "Gamma Co", "c", []), (4, 4, "Delta Corp", "d", []), (5, 5, "Eta Ltd", "e", []), (6, None, "No Id", "f", [])]
    registry = spark.createDataFrame(rows, "ord long, cik long, name string, entity_type string, former_names array<string>")
    examples = datasets.distractor_examples(registry).collect()
    want = datasets.first_examples(registry.filter("cik is not null")).count()
    assert len(examples) == want and all(len(r.candidates) == 5 and r.cik in {c.cik for c in r.candidates} for r in examples)
    assert Counter(r.cik for r in examples)[2] == 2 * Counter(r.cik for r in examples)[3]
    assert builds.distractor_chats(registry).count() == want
    kept = Counter((r.cik, r.attempt) for r in datasets.retrieval_examples(registry, registry, k=3).collect())
    assert kept and all(n == (2 if cik == 2 else 1) for (cik, _), n in kept.items())


def test_waves_stop_early(spark, entities, monkeypatch):
    """As all attempts at once, and targets that have all their examples take no part in later waves."""
    asked = []
    find = datasets.top_k
    monkeypatch.setattr(datasets, "top_k", lambda queries, registry, k: asked.append(queries.count()) or find(queries, registry, k))
    small = entities.filter("cik <= 30")
    rows = sorted((r.cik, r.attempt, r.nth) for r in datasets.retrieval_examples(entities, small, examples=2).collect())
    assert len(asked) == 3 and asked[0] > asked[1] > asked[2]
    tried = datasets.hits(entities, small, 0, 6, 5).orderBy("cik", "attempt").collect()
    want = defaultdict(list)
    for r in tried:
        if len(want[r.cik]) < 2:
            want[r.cik].append((r.cik, r.attempt, len(want[r.cik]) + 1))
    assert rows == sorted(x for v in want.values() for x in v)


def test_names_from_replies(spark):
    candidates = [("Alpha Widgets, Inc.", 1), ("Beta Holdings", 2)]
    rows = spark.createDataFrame([(t, [(n, c) for n, c in candidates]) for t in ("ALPHA WIDGETS INC", "beta holding", "gamma", None, "")], "t string, candidates array<struct<name string, cik long>>")
    assert [r[0] for r in rows.select(resolve.by_name(F.col("candidates"), F.col("t"))["cik"]).collect()] == [1, 2, None, None, None]


def test_whole_data_sets(spark, entities, tmp_path):
    held = spark.createDataFrame([(3,), (4,)], "cik long")
    inputs = datasets.first_examples(entities).filter("cik % 7 = 0").select("input")
    small = entities.filter("cik < 40")
    made = {"plain": builds.plain_chats(entities), "second": builds.second_chats(entities, inputs), "drawn": builds.distractor_chats(entities), "found": builds.retrieval_chats(small, held, examples=1)}
    for name, rows in made.items():
        rows = rows.collect()
        assert rows and all([m.role for m in r.messages] == ["system", "user", "assistant"] and json.loads(r.messages[2].content)["cik"] is not None for r in rows), name
        sizes = Counter(r.split for r in rows)
        if name in ("plain", "drawn"):
            assert sizes["test"] == sizes["valid"] == max(50, len(rows) // 10)
        else:
            assert sizes["valid"] == min(len(rows), max(100, int(len(rows) * (0.12 if name == "second" else 0.15)))) and sizes["train"] == len(rows) - sizes["valid"]
        assert all(r.difficulty in ("hard", "easy") for r in rows)
    assert not {json.loads(r.messages[2].content)["cik"] for r in made["found"].collect()} & {3, 4}
    examples = datasets.distractor_examples(entities).collect()
    assert len(examples) == datasets.first_examples(entities).count()
    assert all(len({c.cik for c in r.candidates}) == 5 and r.cik in {c.cik for c in r.candidates} for r in examples)
    orders = {(r.cik, tuple(c.cik for c in r.candidates)) for r in examples}
    assert len(orders) > 0.95 * len(examples)  # each example has draws of its own
    same, other = (sorted(map(str, builds.plain_chats(entities, seed=s).collect())) for s in (5, 6))
    assert same == sorted(map(str, builds.plain_chats(entities.repartition(3), seed=5).collect())) and same != other
    sinks.write_splits(made["drawn"], str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == len(examples) and {r.split for r in back.select("split").distinct().collect()} == {"train", "test", "valid"}


# Ten queries that a demonstration asks.
DEMO = [
    ("dba Apple, Inc., a Delaware corporation", "Apple Inc."),
    ("NVIDIA CORPORATION", "NVIDIA CORP"),
    ("Tesla, Inc. (formerly known as Tesla Motors, Inc.)", "Tesla, Inc."),
    ("MICROSOFT CORP /DE/", "MICROSOFT CORP"),
    ("JPMorgan Chase & Co, the Company", "JPMORGAN CHASE & CO"),
    ("Walmart Inc.", "Walmart Inc."),
    ("Berkshire Hathaway Inc /formerly/", "BERKSHIRE HATHAWAY INC"),
    ("meta platforms inc", "Meta Platforms, Inc."),
    ("Exxon Mobil Corporation (successor to former entity)", "EXXON MOBIL CORP"),
    ("COCA-COLA CO", "COCA COLA CO"),
]


def test_ten_demonstration_queries(spark):
    others = ["Applied Materials Inc", "Coca-Cola Consolidated, Inc.", "Walmart de Mexico", "Tesla Exploration Ltd", "Berkshire Hills Bancorp", "Meta Financial Group", "Mobile Mini Inc"]
    registry = spark.createDataFrame([(i, 100 + i, n, "corp", ["Tesla Motors, Inc."] if n == "Tesla, Inc." else []) for i, n in enumerate([n for _, n in DEMO] + others)], "ord long, cik long, name string, entity_type string, former_names array<string>")
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(DEMO)], "qid long, query string")
    found = {r.qid: r for r in plans.with_candidates(queries, registry).collect()}
    assert len(found) == 10 and sum(DEMO[q][1] in {c.name for c in r.candidates} for q, r in found.items()) >= 8
    hits = {r.qid: r.ord for r in lookup.cascade(queries, registry).collect()}
    assert sum(hits[i] == i for i in range(10)) >= 9


def test_reports(spark, tmp_path):
    flags = spark.createDataFrame([(True, True, "hard"), (False, True, "easy"), (True, False, "easy"), (True, True, "other")], "name_match boolean, cik_match boolean, difficulty string").withColumn("full_match", F.col("name_match") & F.col("cik_match"))
    both = score.report(flags, "one").union(score.report(flags.limit(0), "none")).cache()
    sinks.write_reports(both, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in (tmp_path / "r" / "text").glob("*.txt"))
    assert "=== one (n=4) ===" in text and "  names, overall: 75.0%" in text and "  names, easy: 50.0%" in text and "=== none (n=0) ===" in text
    assert {r.model: r.name_match_hard for r in spark.read.json(str(tmp_path / "r" / "json")).collect()} == {"one": 1.0, "none": 0.0}
    got = spark.range(1).select(prompts.padded_id(F.lit(320193)), prompts.templated(prompts.chat("s", F.lit("u"), F.lit("r")))).first()
    assert got[0] == "0000320193" and got[1].endswith("<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\nr<|im_end|>\n<|im_start|>assistant\n")
    assert splits.head(spark.range(9), 0, "id").count() == 9 and [r.id for r in splits.head(spark.range(9), 2, "id").collect()] == [0, 1]


def test_replies(spark):
    replies = ['```json\n{"cik": "320193", "canonical_name": "A"}\n```', "no json", '{"cik": 1', "{}", 'say {"cik": 7} or {"x": 1}', ' {"cik":7} ']
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select(resolve.parsed(F.col("r")).alias("v")).select(F.col("v").isNotNull(), F.try_variant_get("v", "$.cik", "string"), F.schema_of_variant("v")).collect()
    assert [tuple(r)[:2] for r in rows] == [(True, "320193"), (False, None), (False, None), (True, None), (False, None), (True, "7")]
    odd = spark.createDataFrame([('{"cik":1,"cik":2}',), ('{"cik":NaN}',), (None,), ("",)], "r string").select(resolve.parsed(F.col("r")).isNull().alias("none"))
    assert all(r.none for r in odd.collect())
    flags = spark.createDataFrame([("0000320193", "320193", " apple ", "Apple"), (None, "1", None, "x"), ("00", "0", "a", "b")], "a string, b string, c string, d string")
    assert [tuple(r) for r in flags.select(score.same_cik(F.col("a"), F.col("b")), score.same_name(F.col("c"), F.col("d")), score.strict(F.col("c"), F.col("d"))).collect()] == [(True, True, False), (False, False, False), (True, False, False)]
    assert spark.range(0).select(F.lit(True).alias("f")).agg(score.share(F.col("f"))).first()[0] == 0.0


def test_examples(spark, entities):
    rows = datasets.first_examples(entities).collect()
    former = datasets.useful_former(entities).count()
    assert len(rows) == former + 200 * 8 and Counter(r.branch for r in rows) == {"former": former, "noisy": 1000, "suffix": 400, "identity": 200}
    assert sorted(map(str, rows)) == sorted(map(str, datasets.first_examples(entities.repartition(9)).collect()))
    held = datasets.first_examples(entities).filter("cik % 7 = 0").select("input")
    left = {r.input for r in datasets.second_examples(entities, held).collect()}
    assert left and not left & {r.input for r in held.collect()}


def test_retrieval_examples_hold_their_target(spark, entities):
    rows = datasets.retrieval_examples(entities, entities.filter("cik < 8")).collect()
    assert rows and all([c["rank"] for c in r.candidates] == [1, 2, 3, 4, 5] and any((c.cik, c.name) == (r.cik, r.canonical_name) for c in r.candidates) for r in rows)
    assert max(Counter(r.cik for r in rows).values()) <= 5 and all(r.nth <= 5 for r in rows)
    # all attempts by brute force: the first 5 of 15 whose 5 best candidates hold the target
    choices = [(r.ord, r.cik, r.name, [sort_tokens(plain(r.name))] + [sort_tokens(f.lower()) for f in [x for x in r.former_names if x][-1:]]) for r in entities.collect()]
    want = defaultdict(list)
    for a in datasets.attempts(entities.filter("cik < 8"), 15).orderBy("cik", "attempt").collect():
        text = sort_tokens(plain(a.query))
        best = sorted((-max(simple_ratio(text, t) for t in ts), o, c, n) for o, c, n, ts in choices)[:5]
        if len(want[a.cik]) < 5 and any((c, n) == (a.cik, a.canonical_name) for _, _, c, n in best):
            want[a.cik].append((a.attempt, [c for _, _, c, _ in best]))
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.nth):
        got[r.cik].append((r.attempt, [c.cik for c in r.candidates]))
    assert got == {c: v for c, v in want.items() if v}


@pytest.mark.parametrize("n", [0, 1, 3, 5, 30, 2500])
def test_random_distractors(spark, n):
    registry = spark.range(n).select((F.col("id") * 3).alias("cik"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("entity_type"))
    got = defaultdict(list)
    for r in datasets.random_distractors(registry.union(spark.sql("SELECT cast(null AS long), 'no id', 't'"))).collect():
        got[r.cik].append((r.slot, r.candidate_cik))
    most = min(5, n)
    assert len(got) == n and all(sorted(s for s, _ in v) == list(range(1, most + 1)) and len({c for _, c in v}) == most and cik in {c for _, c in v} for cik, v in got.items())


def test_all_candidates_are_drawn_equally_often(spark):
    registry = spark.range(12).select(F.col("id").alias("cik"), F.lit("x").alias("name"), F.lit("t").alias("entity_type"))
    examples = spark.range(12).crossJoin(spark.range(300).withColumnRenamed("id", "variant")).select(F.col("id").alias("cik"), "variant")
    rows = datasets.distractors(examples, datasets.circle(registry, "s"), ["cik", "variant"], 5, "s").filter("cik <> candidate.cik")
    n = Counter((r.cik, r.c) for r in rows.select("cik", F.col("candidate.cik").alias("c")).collect())
    assert len(n) == 12 * 11 and sum(n.values()) == 12 * 300 * 4 and all(70 < v < 150 for v in n.values())  # 109 expected


def test_drawn_candidates_are_met_in_one_join(spark):
    """Examples know their place and take their columns along; the candidates are those that are drawn for examples that don't."""
    registry = sources.entities(spark, "/root/testdata/sf0.001")
    found, key = datasets.distractor_examples(registry), ["ord", "branch", "variant"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = defaultdict(list)
    examples = datasets.first_examples(registry, more=("ord",))
    for r in datasets.distractors(examples, datasets.circle(registry, "distractor"), key, 5, "distractor", own="ord").orderBy("slot").collect():
        want[r.ord, r.branch, r.variant].append((r.slot, r.candidate.cik))
    assert {(r.ord, r.branch, r.variant): [(c.slot, c.cik) for c in r.candidates] for r in found.collect()} == want


def test_the_corpus_operators_are_not_imported():
    for path in (Path(__file__).parent.parent / "rosterlink").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_splits(spark):
    rows = spark.range(1000).repartition(5)
    placed = splits.shuffled_places(rows, "id", "s").collect()
    assert sorted(r.place for r in placed) == list(range(1, 1001))
    sizes = Counter(r.split for r in splits.split_rows(rows, "id", "s", {"test": 0.1, "valid": 0.12}, 50).collect())
    assert sizes == {"test": 100, "valid": 120, "train": 780}
    small = Counter(r.split for r in splits.split_rows(rows.limit(120), "id", "s", {"test": 0.1, "valid": 0.1}, 50).collect())
    assert small == {"test": 50, "valid": 50, "train": 20}
    by = defaultdict(set)
    for r in splits.split_by_entity(rows.select((F.col("id") % 50).alias("e")), "e", "s", {"test": 0.2}).collect():
        by[r.e].add(r.split)
    assert all(len(v) == 1 for v in by.values()) and {"test", "train"} == set().union(*by.values())
    odd = spark.sql("SELECT * FROM VALUES (1, 'a', 2, 3, 4), (1, 'a', 2, 3, 4), (null, null, null, null, null) AS t(id, u, part, nth, base)").withColumns({c: F.lit(c) for c in ("place", "total", "split", "key", "row")})
    kept = [c for c in odd.columns if c != "split"]
    got = splits.split_rows(odd, "id", "s", {"test": 0.5}, 2)
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, odd.select(kept).collect())) and Counter(r.split for r in got.collect()) == {"test": 2, "train": 1}
    assert splits.split_rows(odd.limit(0), "id", "s", {"test": 0.5}, 2).count() == 0
    hot = spark.range(4000).select(F.lit(7).alias("id"), F.col("id").alias("x"))  # one key for all: rows come by their content, whatever the partitions
    one, two = ({r.x: r.place for r in splits.shuffled_places(hot.repartition(n), "id", "s").collect()} for n in (1, 7))
    assert one == two and sorted(one.values()) == list(range(1, 4001))


def test_entities_stay_together(spark):
    """Exact sizes up to one entity; a heavy entity, null entities, minima."""
    rows = spark.range(3000).select("id", F.when(F.col("id") < 900, 0).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 211).alias("e")).withColumn("split", F.lit("old"))
    for shares, least in (({"test": 0.1, "valid": 0.1}, 50), ({"test": 0.01}, 400), ({"test": 0.9, "valid": 0.9}, 1)):
        found = splits.split_entities(rows, "e", "s", shares, least).collect()
        by, sizes = defaultdict(set), Counter(r.split for r in found)
        n = Counter(r.e for r in found)
        for r in found:
            by[r.e].add(r.split)
        assert len(found) == 3000 and all(len(v) == 1 for v in by.values())
        left = 3000
        for name, share in shares.items():
            target = min(left, max(least, int(3000 * share)))
            assert target <= sizes[name] < target + max([k for e, k in n.items() if name in by[e]], default=1)
            left -= sizes[name]
    assert splits.split_entities(rows.limit(0), "e", "s", {"test": 0.5}, 10).count() == 0


def test_running_share(spark):
    rows = score.running_share(spark.range(3000).select((F.col("id") * 2).alias("id")), "id", F.col("id") % 3 == 0).orderBy("id").collect()
    hits = 0
    for i, r in enumerate(rows):
        hits += i * 2 % 3 == 0
        assert (r.place, r.hits) == (i + 1, hits)
    days = spark.range(5000).select(F.concat(F.lit("day "), (F.col("id") % 3).cast("string")).alias("day"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("n"), (F.col("id") % 5 == 0).alias("f")).repartition(6)
    got = score.running_share(days, ["day", "n"], F.col("f")).orderBy("place").collect()
    want = sorted(days.collect(), key=lambda r: (r.day, r.n is not None, r.n))
    assert [(r.day, r.n) for r in got] == [(r.day, r.n) for r in want] and [r.place for r in got] == list(range(1, 5001))
    ends = {(r.day, r.n): r.hits for r in got if r.n is not None}
    total = 0
    for r in want:
        total += r.f
        assert r.n is None or ends[r.day, r.n] == total
    assert score.running_share(days.limit(0), "day", F.col("f")).count() == 0


def test_prompts(spark):
    rows = spark.sql("SELECT 'q' AS q, array(named_struct('name', 'A \"x\"', 'cik', 5L, 'entity_type', 'corp', 'score', 92.5)) AS c, cast(array() AS array<struct<name string, cik bigint, entity_type string, score double>>) AS none, cast(null AS string) AS n")
    got = rows.select(prompts.user_prompt(F.col("q"), F.col("c"), True), prompts.user_prompt(F.col("q"), F.col("none")), prompts.bracketed_lines(F.col("c")), prompts.answer(F.col("n"), F.lit(5), F.lit("x"), F.lit(False)), prompts.chat("s", F.col("q"), F.lit("r"))).first()
    assert got[0].endswith('1. canonical_name: "A "x""  cik: 5 (score: 92)') and got[1].endswith(prompts.NO_CANDIDATES) and got[2] == '[1] A "x" | CIK: 5 | Type: corp'
    assert json.loads(got[3]) == {"canonical_name": None, "cik": 5, "entity_type": "x", "is_former_name_input": False} and [m.role for m in got[4]] == ["system", "user", "assistant"]


def test_selectors(spark, entities):
    found = plans.found(spark, DIR)
    first = {r.qid: r.answer_cik for r in selector.first_candidate(found).collect()}
    assert first == {r.qid: r.candidates[0].cik for r in found.collect()}
    rules = selector.rule_matcher(entities)(found).collect()
    assert len(rules) == len(first) and all(r.answer_name for r in rules if r.answer_cik is not None)

    def load():
        def ask(texts):
            return ['```json\n{"cik": ' + t.split("cik: ")[2].split("\n")[0] + "}\n```" if "cik: " in t else "" for t in texts]

        return ask

    second = {r.qid: r.answer_cik for r in selector.model(load)(found).collect()}
    assert second == {r.qid: r.candidates[1].cik for r in found.collect()}
    assert spark.sql("SELECT 'a\\nb\\nc\\nd' AS t").select(prompts.first_lines(F.col("t"))).first()[0] == "a\nb\nc"


def test_names_stand_in_for_missing_ids(spark):
    candidates = [("Alpha Widgets, Inc.", 1), ("Beta Holdings", 2), ("Holdings Beta", 3)]
    said = [(1, 1, "Beta Holdings", 1), (2, 9, "BETA HOLDING", 2), (3, None, "widgets alpha inc", 1), (4, None, "quite another", None), (5, None, None, None), (6, 9, "", None)]
    rows = spark.createDataFrame([(q, cik, name, [(r, c, n, "corp", 90.0) for r, (n, c) in enumerate(candidates, 1)]) for q, cik, name, _ in said], "qid long, said long, text string, candidates array<struct<rank int, cik long, name string, entity_type string, score double>>")
    want = {q: w for q, _, _, w in said}
    assert {r.qid: r.cik for r in rows.select("qid", resolve.by_id_or_name(F.col("candidates"), F.col("said"), F.col("text")).alias("hit")).select("qid", "hit.cik").collect()} == want
    replies = {str(q): json.dumps({"cik": cik, "canonical_name": name}) for q, cik, name, _ in said}

    def load():
        return lambda texts: [replies[t.split('"')[1]] for t in texts]

    found = rows.select("qid", F.col("qid").cast("string").alias("query"), "candidates")
    assert {r.qid: r.answer_cik for r in selector.model(load)(found).collect()} == want
    found = {r.qid: r for r in plans.resolved(spark, DIR).collect()}
    got = {r.qid: r for r in plans.resolve_by_id(spark, DIR).collect()}
    assert any(q % 100 == 0 for q in got) and all(r.resolved_cik == found[q].candidates[1].cik and r.name == found[q].candidates[1].name for q, r in got.items())


def lines_of(folder):
    """All rows of a written folder, whose files may be empty."""
    return [json.loads(line) for p in folder.glob("*.json") for line in p.read_text().splitlines()]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw.jsonl").write_text('{"cik": 1, "name": "A", "entityType": null, "formerNames": [{"name": "B"}, {"from": "x"}]}\n\n{"cik": 2, "name": ""}\n')
    raw = sources.json_lines(spark, str(tmp_path / "raw.jsonl"), sources.RAW)
    assert [(r.cik, r.former_names) for r in sources.registry_rows(raw).collect()] == [(1, ["B", ""])]
    (tmp_path / "list.json").write_text('{"0": {"cik_str": 1, "ticker": "a", "title": "A"}, "1": {"cik_str": 9, "ticker": "z", "title": "Z"}}')
    listed = sources.listed(spark, str(tmp_path / "list.json"))
    assert [r.name for r in sources.enriched(listed, raw).collect()] == ["A"]
    ordered = sources.with_order(sources.registry_rows(raw), sources.registry_rows(raw))
    assert len({r.ord for r in ordered.collect()}) == 2
    sinks.write_splits(spark.createDataFrame([("a", "test"), (None, "train")], "x string, split string"), str(tmp_path / "out"))
    assert lines_of(tmp_path / "out" / "split=train") == [{"x": None}] and lines_of(tmp_path / "out" / "split=test") == [{"x": "a"}]
    with pytest.raises(Exception, match="blank line"):
        sources.json_lines(spark, str(tmp_path / "raw.jsonl"), sources.RAW, strict=True).collect()
    (tmp_path / "good.jsonl").write_text('{"cik": 1, "name": "A", "formerNames": []}\n')
    assert [r.cik for r in sources.json_lines(spark, str(tmp_path / "good.jsonl"), sources.RAW, strict=True).collect()] == [1]
    sinks.write_json_lines(spark.createDataFrame([("é", None)], "x string, y string"), str(tmp_path / "rows"))
    assert lines_of(tmp_path / "rows") == [{"x": "é", "y": None}]
    assert sinks.line_count(spark, str(tmp_path / "raw.jsonl")) == 3 and len(sinks.checksums(spark, str(tmp_path / "list.json")).first().sha256) == 64


def test_fetching_with_retries():
    waits, replies = [], [urllib.error.HTTPError("u", 429, "", {}, None), ValueError(), "ok"]

    def get(url, agent):
        x = replies.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert sources.fetched("u", "me", get=get, wait=waits.append) == "ok" and waits == [1, 2]
    replies[:] = [urllib.error.HTTPError("u", 404, "", {}, None)]
    with pytest.raises(urllib.error.HTTPError):
        sources.fetched("u", "me", get=get, wait=waits.append)
    replies[:] = [ValueError()] * 3
    with pytest.raises(RuntimeError):
        sources.fetched("u", "me", get=get, wait=waits.append)


def test_fetching_all_skips_what_fails(spark):
    def get(url, agent):
        if url.endswith("2"):
            raise urllib.error.HTTPError(url, 404, "", {}, None)
        return f"{agent}:{url}"

    rows = sources.fetch_all(spark.createDataFrame([(1,), (2,), (3,)], "cik long"), "at/{cik}", "me", pause=0.0, get=get).collect()
    assert sorted((r.cik, r.reply) for r in rows) == [(1, "me:at/1"), (3, "me:at/3")]


def test_entry(spark):
    import __spark_entry__

    assert plans.flagship(spark, DIR).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_of_input(spark, tmp_path):
    """A small file before a large one, one file in many parts, and names that sort."""
    row = '{"cik": %d, "name": "n%d", "formerNames": []}\n'
    (tmp_path / "b.jsonl").write_text("".join(row % (k, k) for k in range(10, 4000)))
    (tmp_path / "a.jsonl").write_text(row % (1, 1))
    (tmp_path / "c.jsonl").write_text("\n" + row % (5000, 5000) + row % (4999, 0))
    want = [1, *range(10, 4000), 5000, 4999]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (size, "20k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", "1k")
            raw = sources.json_lines(spark, str(tmp_path), sources.RAW)
            assert [r.cik for r in sources.with_order(sources.registry_rows(raw)).orderBy("ord").collect()] == want
        both = sources.with_order(raw.filter("cik > 3990").select("cik", "name"), sources.json_lines(spark, str(tmp_path / "a.jsonl"), sources.RAW).select("cik", "sic"))
        assert [(r.cik, r.name) for r in both.orderBy("ord").collect()] == [*((k, f"n{k}") for k in range(3991, 4000)), (5000, "n5000"), (4999, "n0"), (1, None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.x for r in sources.with_order(spark.createDataFrame([(3,), (1,), (2,)], "x int").coalesce(1)).orderBy("ord").collect()] == [3, 1, 2]


def test_digests_of_whole_files(spark, tmp_path):
    """Files in many parts, with and without a last line's end, other line ends, bytes that are no text, and empty ones."""
    folder = tmp_path / "files"
    folder.mkdir()
    files = {"big": b"".join(b"line %d \xc3\xa9\n" % k for k in range(30_000)), "open": b"a\nb", "returns": b"a\r\nb\r\rc\n\n\n", "bytes": bytes(range(256)) * 3, "empty": b"", "one": b"\n", "blank": b"x\n\n", "a b": b"y"}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r.sha256 for r in sinks.checksums(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}


def test_replies_as_a_source(spark, tmp_path):
    folder = str(tmp_path / "captured")
    rows = spark.createDataFrame([(k, json.dumps({"cik": k, "name": f"n{k} é\n"})) for k in range(0, 5000, 7)] + [(None, "x"), (3, None)], "cik long, reply string")
    replies.capture(rows, folder)
    spark.dataSource.register(replies.Replies)
    back = spark.read.format("replies").option("folder", folder).load()
    assert sorted((r.cik, r.reply) for r in back.collect()) == sorted((r.cik, r.reply) for r in rows.filter("cik is not null and reply is not null").collect())
    assert back.rdd.getNumPartitions() == 5
    some = spark.read.format("replies").option("folder", f"file://{folder}").options(first=1990, last=2010).load()
    assert sorted(r.cik for r in some.collect()) == [1995, 2002, 2009] and some.rdd.getNumPartitions() == 2
    reader = replies.RepliesReader({"template": "at/{cik:010d}", "agent": "me", "first": "3", "last": "9", "parts": "3", "pause": "0"})
    seen = []

    def get(url, agent):
        seen.append(url)
        if url.endswith("5"):
            raise urllib.error.HTTPError(url, 404, "", {}, None)
        return f"{agent}:{url[-1]}"

    reader.get = get
    assert [row for part in reader.partitions() for row in reader.read(part)] == [(k, f"me:{k}") for k in (3, 4, 6, 7, 8, 9)] and seen[0] == "at/0000000003"
    for options in ({}, {"folder": "x", "template": "y"}, {"template": "y"}, {"folder": "s3://x"}):
        with pytest.raises(ValueError):
            replies.RepliesReader(options)


def test_white_space_of_all_kinds(spark):
    rows = spark.createDataFrame([("b\u00a0a c\u3000d", "A\u00a0and\u2009B, Inc", "X\u00a0(fka)\u00a0", "A\u00a0&\u00a0B,\u3000Inc")], "t string, u string, v string, w string")
    got = rows.select(similarity.token_sorted(F.col("t")), names.suffix_form(F.col("u")), names.basic_form(F.col("t")), names.without_noise(F.col("v")), names.without_comma(F.col("w"))).first()
    assert tuple(got) == (sort_tokens("b\u00a0a c\u3000d"), "a b inc", "b a c d", "X", "A\u00a0&\u00a0B Inc")


def test_entry_finds_what_is_there(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "find_spec", lambda name: None)
    assert "pipeline" not in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) == set(plans_sql.SQL)
