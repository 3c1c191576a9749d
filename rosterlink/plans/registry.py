"""The queries over the stand-in tables, each over its whole table; searches take as queries the rows whose id is divisible by 50."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.draws import uniform
from ..functions.similarity import token_sorted
from ..operators import builds, datasets, lookup, prompts, ranker, resolve, score, search, selector, splits
from ..operators.order import placed
from ..shared import shared_folder, stored
from ..sources import sinks
from ..sources.registry import RAW, entities, json_lines, registry_rows, with_order
from ..sources.replies import Replies, capture

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry with a wrapped form of each name, the wrapper chosen by the id; some with other white space than that of ASCII."""
    wrapper = F.element_at(F.array(*map(F.lit, names.WRAPPERS)), (F.col("cik") % len(names.WRAPPERS) + 1).cast("int"))
    text = F.replace(wrapper, F.lit("{name}"), F.col("name"))
    other = F.when(F.col("cik") % 11 == 0, F.translate(text, " ", "\u00a0")).when(F.col("cik") % 17 == 0, F.translate(text, " ", "\u3000"))
    return entities(spark, sf_dir).withColumn("messy", F.coalesce(other, text))


def asked(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(qid, query, cik, name): noisy forms of every 50th row; more may name kinds, the number of kinds of noise."""
    rows = entities(spark, sf_dir).filter(F.col("cik") % 50 == 0)
    return names.with_messy(rows, "name", F.col("cik"), F.lit("query"), to="query").select(F.col("cik").alias("qid"), "query", "cik", "name", *more)


def with_candidates(queries: DataFrame, registry: DataFrame, k: int = 3) -> DataFrame:
    """queries with their k candidates, best first."""
    best = search.top_k(queries, registry, k).join(registry.select("ord", "cik", F.col("name"), "entity_type"), "ord")
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "cik", "name", "entity_type", "score"))).alias("candidates"))
    return queries.join(lists, "qid")


def found(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """asked with its k candidates: (qid, query, cik, name, candidates)."""
    return with_candidates(stored(asked(spark, sf_dir), "asked"), entities(spark, sf_dir), k)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy queries resolved to their first candidate, and whether that is right."""
    first = F.get("candidates", F.lit(0))
    return found(spark, sf_dir).select("qid", "query", first["cik"].alias("found_cik"), first["name"].alias("found_name"), F.round(first["score"], 6).alias("score"), score.strict(F.col("name"), first["name"]).alias("name_match"), score.strict(F.col("cik"), first["cik"]).alias("cik_match"))


def registry_projection(spark, sf_dir):
    return entities(spark, sf_dir).filter("name is not null and name <> ''").select("cik", "name", names.filled(F.col("entity_type")).alias("entity_type"), names.basic_form(F.col("name")).alias("name_norm"), F.size("former_names").cast("long").alias("n_former"), F.array_join("former_names", "|").alias("former"))


def former_name_unnest(spark, sf_dir):
    return datasets.useful_former(entities(spark, sf_dir)).select("cik", F.col("nth").cast("long").alias("nth"), "former")


def former_name_last(spark, sf_dir):
    last = F.try_element_at(F.filter("former_names", lambda f: f != ""), F.lit(-1))
    return entities(spark, sf_dir).select("cik", last.alias("former")).filter("former is not null")


def registry_union(spark, sf_dir):
    one = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    two = read(spark, sf_dir, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return one.unionByName(two)


def page_titles(spark, sf_dir):
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return read(spark, sf_dir, "pages").select("page_id", title.alias("title"), names.without_noise(title).alias("cleaned"), names.lookup_form(title).alias("norm"))


def strip_noise(spark, sf_dir):
    return messy(spark, sf_dir).select("cik", "messy", names.without_noise(F.col("messy")).alias("cleaned"))


def normalize_suffix(spark, sf_dir):
    return messy(spark, sf_dir).select("cik", names.suffix_form(F.col("name")).alias("norm"), names.lookup_form(F.col("messy")).alias("messy_norm"))


def normalize_basic(spark, sf_dir):
    return messy(spark, sf_dir).select("cik", names.basic_form(F.col("messy")).alias("norm"))


def comma_before_suffix(spark, sf_dir):
    rows = entities(spark, sf_dir).filter(F.contains("name", F.lit(",")))
    return rows.select("cik", names.without_comma(F.col("name")).alias("bare"), (names.without_comma(F.col("name")) != F.col("name")).alias("changed"))


def title_case(spark, sf_dir):
    rows = entities(spark, sf_dir).select(F.col("name").alias("text")).union(read(spark, sf_dir, "nation").select("n_name")).union(read(spark, sf_dir, "region").select("r_name"))
    return rows.select("text", names.title(F.col("text")).alias("titled"))


def suffix_swap(spark, sf_dir):
    u = lambda salt: uniform(salt, F.col("cik"), F.lit("one"))
    return entities(spark, sf_dir).select("cik", names.swapped(F.col("name"), u("swap"), u("gap")).alias("swapped"))


def casing_noise(spark, sf_dir):
    return entities(spark, sf_dir).select("cik", names.recased(F.col("name"), uniform("case", F.col("cik"), F.lit("one"))).alias("recased"))


def punctuation_noise(spark, sf_dir):
    u = lambda salt: uniform(salt, F.col("cik"), F.lit("one"))
    return entities(spark, sf_dir).select("cik", names.repunctuated(F.col("name"), u("joiner"), u("commas"), u("spaces")).alias("noisy"))


def noisy_variants(spark, sf_dir):
    out = datasets.first_examples(entities(spark, sf_dir))
    return out.select("cik", "branch", F.col("variant").cast("long").alias("variant"), "input", "canonical_name", "entity_type", "is_former", "difficulty")


def held_inputs(spark, sf_dir):
    """The first data set's noisy inputs of every seventh company, as inputs to keep out."""
    return datasets.first_examples(entities(spark, sf_dir)).filter("cik % 7 = 0").select("input")


def variants_v3_counts(spark, sf_dir):
    rows = datasets.flagged(datasets.second_candidates(entities(spark, sf_dir)), held_inputs(spark, sf_dir))
    kept = F.col("changed") & ~F.col("in_test")
    return rows.groupBy("branch").agg(F.count(F.lit(1)).alias("tried"), F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("difficulty") == "hard")).alias("hard"), F.count_if(kept & F.col("is_former")).alias("former"), F.count_if(F.col("in_test")).alias("skipped"), F.count_distinct("input").alias("inputs"))


def decontaminate_exact(spark, sf_dir):
    rows = stored(datasets.first_examples(entities(spark, sf_dir)), "examples")  # made once, read as both sides
    return datasets.without_inputs(rows, rows.filter("cik % 7 = 0")).select("cik", "branch", F.col("variant").cast("long").alias("variant"), "input")


def decontaminate_contains(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return datasets.containing(docs, items)


def holdout_antijoin(spark, sf_dir):
    return datasets.without_ciks(entities(spark, sf_dir), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cik"))).select("cik", "name")


def random_distractors(spark, sf_dir):
    return datasets.random_distractors(entities(spark, sf_dir)).select("cik", F.col("slot").cast("long").alias("slot"), "candidate_cik")


def token_sort(spark, sf_dir):
    return messy(spark, sf_dir).select("cik", token_sorted(F.col("messy")).alias("sorted"))


def fuzzy_topk(spark, sf_dir):
    best = search.top_k(asked(spark, sf_dir), entities(spark, sf_dir), 3)
    return best.select("qid", F.col("rank").cast("long").alias("rank"), "ord", F.round("score", 6).alias("score"))


def fuzzy_topk_all_former(spark, sf_dir):
    best = search.top_k_all_former(asked(spark, sf_dir), entities(spark, sf_dir), 3)
    return best.select("qid", F.col("rank").cast("long").alias("rank"), "ord", F.round("score", 6).alias("score"))


def fuzzy_threshold(spark, sf_dir):
    return search.above(asked(spark, sf_dir), entities(spark, sf_dir), 80.0).select("qid", "ord", F.round("score", 6).alias("score"))


def fuzzy_threshold_high(spark, sf_dir):
    """At a threshold from which on both sides meet by the index."""
    return search.above(asked(spark, sf_dir), entities(spark, sf_dir), 90.0).select("qid", "ord", F.round("score", 6).alias("score"))


def partial_ratio_top1(spark, sf_dir):
    queries = asked(spark, sf_dir).select("qid", names.without_noise(F.col("query")).alias("query"))
    best = search.best_partial(queries, lookup.fallback_choices(entities(spark, sf_dir)))
    return best.select("qid", "ord", F.round("score", 6).alias("score"))


def exact_lookup(spark, sf_dir):
    queries = messy(spark, sf_dir).select(F.col("cik").alias("qid"), F.col("messy").alias("query"))
    return lookup.exact(queries, entities(spark, sf_dir)).select("qid", "norm", "ord")


def match_cascade(spark, sf_dir):
    found = lookup.cascade(asked(spark, sf_dir).select("qid", "query"), entities(spark, sf_dir), scorers=("token_sort",))
    return found.select("qid", "ord", "how", F.round("score", 6).alias("score"))


def match_cascade_two_scorers(spark, sf_dir):
    found = lookup.cascade(asked(spark, sf_dir).select("qid", "query"), entities(spark, sf_dir))
    return found.select("qid", "ord", "how", F.round("score", 6).alias("score"))


def retrieval_examples(spark, sf_dir):
    registry = entities(spark, sf_dir)
    targets = datasets.without_ciks(registry, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cik")))
    out = datasets.retrieval_examples(registry, targets).withColumn("c", F.explode("candidates"))
    return out.select("cik", "attempt", F.col("nth").cast("long").alias("nth"), "query", "canonical_name", "entity_type", F.col("c.rank").cast("long").alias("rank"), F.col("c.cik").alias("candidate_cik"), F.col("c.name").alias("candidate_name"), F.round("c.score", 6).alias("score"), "is_former", "difficulty")


def ranker_report(spark, sf_dir):
    """A ranker fitted on the retrieved examples of most companies, and the first candidate, over the examples of the others: accuracy overall, hard and easy."""
    registry = entities(spark, sf_dir)
    rows = datasets.retrieval_examples(registry, registry, examples=2)
    rows = stored(splits.split_entities(rows.withColumn("qid", F.monotonically_increasing_id()), "cik", "ranker", {"test": 0.3}, 50), "examples")
    test = rows.filter("split = 'test'")
    out = None
    for name, select in (("first candidate", ranker.FIRST), ("fitted", ranker.fit(rows.filter("split = 'train'")))):
        flags = select(test).select("difficulty", score.strict(F.col("cik"), F.col("answer_cik")).alias("match"))
        one = flags.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), *score.by_bucket(flags, "match"))
        out = one if out is None else out.union(one)
    return out


def distractor_examples(spark, sf_dir):
    """Examples with drawn candidates, as their prompts and answers."""
    out = datasets.distractor_examples(entities(spark, sf_dir))
    return out.select("cik", "branch", F.col("variant").cast("long").alias("variant"), prompts.listed_prompt(F.col("input"), F.col("candidates")).alias("prompt"), prompts.answer(F.col("canonical_name"), F.col("cik"), F.col("entity_type"), F.col("is_former")).alias("answer"), "difficulty")


def repeated_ciks(spark, sf_dir):
    """The registry with every fortieth row twice, the second time under another ord."""
    rows = entities(spark, sf_dir)
    return rows.union(rows.filter("cik % 40 = 0").withColumn("ord", F.col("ord") + 1_000_000_000))


def distractor_examples_repeated(spark, sf_dir):
    """Examples of a registry with repeated ciks, and how many candidates each has."""
    out = datasets.distractor_examples(repeated_ciks(spark, sf_dir))
    return out.select("ord", "cik", "branch", F.col("variant").cast("long").alias("variant"), "input", F.size("candidates").cast("long").alias("n"), F.exists("candidates", lambda c: c["cik"] == F.col("cik")).alias("has_own"))


def variants_v3(spark, sf_dir):
    """The second data set's rows."""
    out = datasets.second_examples(entities(spark, sf_dir), held_inputs(spark, sf_dir))
    return out.select("cik", "branch", F.col("variant").cast("long").alias("variant"), "input", "canonical_name", "entity_type", "is_former", "difficulty")


def captured_registry(spark, sf_dir):
    """The registry as captured replies of its service, replayed through the data source and read again."""
    former = F.transform("former_names", lambda f: F.struct(f.alias("name"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to")))
    said = F.to_json(F.struct("cik", "name", F.col("entity_type").alias("entityType"), former.alias("formerNames")))
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    capture(entities(spark, sf_dir).select("cik", said.alias("reply")), folder)
    spark.dataSource.register(Replies)
    back = spark.read.format("replies").option("folder", folder).load()
    rows = registry_rows(back.select(F.from_json("reply", RAW).alias("r")).select("r.*"))
    return rows.select("cik", "name", "entity_type", F.array_join("former_names", "|").alias("former"))


def chat_splits(spark, sf_dir):
    """The first data set as chat rows in splits."""
    out = builds.plain_chats(entities(spark, sf_dir))
    return out.select(*(F.col("messages")[i]["content"].alias(name) for i, name in enumerate(("system", "user", "assistant"))), "difficulty", "split")


def candidate_prompt(spark, sf_dir):
    return found(spark, sf_dir).select("qid", prompts.user_prompt(F.col("query"), F.col("candidates")).alias("prompt"), prompts.bracketed_lines(F.transform("candidates", lambda c: c.withField("entity_type", names.filled(c["entity_type"])))).alias("bracketed"))


def model_prompts(spark, sf_dir):
    """What a model is asked: candidates with their scores under one system text, and without any candidate under another."""
    none = F.filter("candidates", lambda c: F.lit(False))
    return found(spark, sf_dir).select("qid", selector.model_prompt(F.col("query"), F.col("candidates"), prompts.SYSTEM_SCORED, True).alias("scored"), selector.model_prompt(F.col("query"), none, prompts.SYSTEM_SHORT).alias("without"))


def formatted(spark, sf_dir):
    """Padded ids, shares in per cent, and the first three lines of a page."""
    page = prompts.first_lines(F.regexp_replace("html", ">", ">\n"))
    return read(spark, sf_dir, "pages").select("page_id", prompts.padded_id(F.col("page_id")).alias("padded"), prompts.percent((F.col("page_id") % 7) / 7).alias("share"), page.alias("head"))


def input_order(spark, sf_dir):
    """The registry written as JSON Lines in several files and read back in order of input: ids and places."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows = entities(spark, sf_dir).select("cik", "name", F.col("entity_type").alias("entityType"))
    sinks.write_json_lines(rows.repartitionByRange(7, "cik").sortWithinPartitions("cik"), folder)
    back = with_order(json_lines(spark, folder, RAW).select("cik", "name"))
    return placed(back, [F.col("ord")]).select("cik", "name", "place")


def file_digests(spark, sf_dir):
    """Names written as lines, a folder for each thousand ids, and the digest of each file."""
    folder = f"{shared_folder(spark)}/names-{uuid.uuid4().hex}"
    rows = entities(spark, sf_dir).select(F.floor(F.col("cik") / 1000).alias("range"), "cik", "name")
    rows.repartition("range").sortWithinPartitions("range", "cik").select("range", "name").write.partitionBy("range").text(folder)
    return sinks.checksums(spark, folder).select(F.regexp_extract("path", "range=([0-9]+)", 1).cast("long").alias("range"), "sha256")


def chat_assembly(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    text = F.array_join(F.transform("m", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")
    return rows.select("conv_id", text.alias("chat"), F.try_element_at("m", F.lit(2))["text"].alias("second"), F.element_at("m", -1)["role"].alias("last_role"), F.size("m").cast("long").alias("turns"))


def answer_json(spark, sf_dir):
    return entities(spark, sf_dir).select("cik", prompts.answer(F.col("name"), F.col("cik"), names.filled(F.col("entity_type")), F.col("cik") % 2 == 0).alias("answer"))


def model_output_parse(spark, sf_dir):
    reply = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")), F.lit("\n```"))
    rows = read(spark, sf_dir, "events").select("event_id", resolve.parsed(reply).alias("v"))
    return rows.select("event_id", F.col("v").isNotNull().alias("parsed"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


def resolved(spark, sf_dir):
    """found with a prediction: the second candidate's name without commas, and its id where the query's id isn't divisible by 100."""
    second = F.coalesce(F.get("candidates", F.lit(1)), F.get("candidates", F.lit(0)))
    return found(spark, sf_dir).withColumn("predicted", F.upper(F.replace(second["name"], F.lit(","), F.lit("")))).withColumn("predicted_cik", F.when(F.col("qid") % 100 != 0, second["cik"]))


def resolve_by_id(spark, sf_dir):
    rows = resolved(spark, sf_dir).withColumn("hit", resolve.by_id_or_name(F.col("candidates"), F.col("predicted_cik"), F.col("predicted")))
    return rows.select("qid", F.coalesce("hit.name", "predicted").alias("name"), F.col("hit.cik").alias("resolved_cik"))


def resolve_by_name(spark, sf_dir):
    """The first candidate equal to the prediction without commas and points, else the most similar one above 75."""
    rows = resolved(spark, sf_dir)
    same = F.exists("candidates", lambda c: resolve.plain(c["name"]) == resolve.plain(F.col("predicted")))
    return rows.select("qid", resolve.by_name(F.col("candidates"), F.col("predicted"))["cik"].alias("resolved_cik"), same.alias("same"))


def scored_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    guess = F.when(F.col("n_chars") > 1000, F.concat(F.lit(" "), F.upper("source"))).when(F.col("n_chars") > 200, F.col("lang"))
    number = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("00"), F.col("doc_id").cast("string"))).when(F.col("n_chars") % 3 == 1, F.col("n_chars").cast("string"))
    rows = rows.select("doc_id", F.when(F.col("toxic") == 1, "hard").when(F.col("quality") == 1, "easy").otherwise("other").alias("difficulty"), score.same_name(F.col("source"), guess).alias("name_match"), score.same_cik(F.col("doc_id"), number).alias("cik_match"))
    return rows.withColumn("full_match", F.col("name_match") & F.col("cik_match"))


def score_rows(spark, sf_dir):
    return scored_labels(spark, sf_dir)


def accuracy_by_bucket(spark, sf_dir):
    rows = scored_labels(spark, sf_dir)
    columns = [c for flag in ("name_match", "cik_match", "full_match") for c in score.by_bucket(rows, flag)]
    out = rows.agg(F.count(F.lit(1)).alias("n"), *columns)
    return out.select("n", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


def eval_report(spark, sf_dir):
    """Both selectors over the noisy queries: a row each."""
    rows = stored(found(spark, sf_dir), "found")
    hard = F.contains(F.lower("query"), F.lit("former")) | F.contains("query", F.lit("/DE/"))
    out = None
    for name, select in (("first candidate", selector.first_candidate), ("rule matcher", selector.rule_matcher(entities(spark, sf_dir), ("token_sort",)))):
        flags = select(rows).select("query", score.strict(F.col("name"), F.col("answer_name")).alias("name_match"), score.strict(F.col("cik"), F.col("answer_cik")).alias("cik_match"))
        one = flags.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("n"), F.count_if("name_match").alias("name_hits"), F.count_if("cik_match").alias("cik_hits"), F.count_if(hard).alias("hard"), F.count_if(hard & F.col("name_match")).alias("hard_hits"), F.round(score.share(F.col("name_match")), 9).alias("hit_rate"))
        out = one if out is None else out.unionByName(one)
    return out


def hybrid_report(spark, sf_dir):
    """The lookup stage alone, over wrapped names: what it finds, finds rightly, and leaves to the next stage.  The whole matcher is in hybrid_report_two_scorers."""
    rows = messy(spark, sf_dir)
    registry = entities(spark, sf_dir).select("ord", F.col("name").alias("found_name"))
    tried = lookup.exact(rows.select(F.col("cik").alias("qid"), F.col("messy").alias("query"), "name"), entities(spark, sf_dir)).join(registry, "ord", "left")
    hit = score.strict(F.col("name"), F.col("found_name"))
    return tried.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col("ord").isNull()).alias("calls"), F.round(F.count_if(F.col("ord").isNull()) / F.count(F.lit(1)), 9).alias("call_rate"), F.round(score.share(hit), 9).alias("accuracy"))


def misspelt(spark, sf_dir):
    """asked with kinds, where every second query lacks the letter in its middle: lookup undoes most other noise."""
    half = F.floor(F.length("query") / 2).cast("int")
    cut = F.concat(F.substring(F.col("query"), F.lit(1), half), F.substring(F.col("query"), half + 2, F.length("query")))
    return asked(spark, sf_dir, "kinds").withColumn("query", F.when(F.col("qid") % 100 == 0, cut).otherwise(F.col("query")))


def hybrid_report_two_scorers(spark, sf_dir):
    """The whole matcher over noisy names, lookup and then both scorers, and the first candidate for what it leaves; accuracy over all, hard (two kinds of noise or more) and easy names."""
    registry, queries = entities(spark, sf_dir), stored(misspelt(spark, sf_dir), "misspelt")
    rows = with_candidates(queries, registry).withColumn("difficulty", F.when(F.col("kinds") >= 2, "hard").otherwise("easy"))
    return selector.hybrid(stored(rows, "found"), registry, selector.first_candidate)


def progress_running(spark, sf_dir):
    rows = score.running_share(read(spark, sf_dir, "events"), "event_id", F.col("value") > 50)
    last = rows.agg(F.max("place").alias("last"))
    kept = rows.crossJoin(F.broadcast(last)).filter((F.col("place") % 50 == 0) | (F.col("place") == F.col("last")))  # one row
    return kept.select("event_id", "place", "hits", F.round("share", 6).alias("share"))


def progress_by_date(spark, sf_dir):
    """Running shares in an order of texts and numbers with many ties in its first part, every fiftieth row."""
    rows = read(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("string"))
    return score.running_share(rows, ["day", "o_orderkey"], F.col("o_orderstatus") == "F").filter("place % 50 = 0").select("o_orderkey", "place", "hits", F.round("share", 6).alias("share"))


def split_rows(spark, sf_dir):
    return splits.split_rows(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "split", {"test": 0.10, "valid": 0.10}, 50)


def split_rows_one_share(spark, sf_dir):
    return splits.split_rows(entities(spark, sf_dir).select("cik"), "cik", "split", {"valid": 0.15}, 100)


def split_by_entity(spark, sf_dir):
    rows = datasets.first_examples(entities(spark, sf_dir)).select("cik", "branch", F.col("variant").cast("long").alias("variant"))
    return splits.split_by_entity(rows, "cik", "entity", {"test": 0.10, "valid": 0.10})


def split_entities(spark, sf_dir):
    """All orders of a customer fall together; sizes are exact up to one customer."""
    return splits.split_entities(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "entity", {"test": 0.12, "valid": 0.10}, 100)


def limit_then_filter(spark, sf_dir):
    """The first 200 rows, and of those the ones marked good: the limit comes first."""
    return read(spark, sf_dir, "labels").orderBy("doc_id").limit(200).filter("quality = 1").select("doc_id", F.col("toxic").cast("long").alias("toxic"))


def file_checksum(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    registry_projection, former_name_unnest, former_name_last, registry_union, page_titles, strip_noise, normalize_suffix, normalize_basic, comma_before_suffix, title_case,
    suffix_swap, casing_noise, punctuation_noise, noisy_variants, variants_v3_counts, decontaminate_exact, decontaminate_contains, holdout_antijoin, random_distractors, token_sort,
    fuzzy_topk, fuzzy_topk_all_former, fuzzy_threshold, fuzzy_threshold_high, partial_ratio_top1, exact_lookup, match_cascade, match_cascade_two_scorers, retrieval_examples, ranker_report, candidate_prompt, model_prompts, formatted, input_order, file_digests, chat_assembly,
    answer_json, model_output_parse, resolve_by_id, resolve_by_name, score_rows, accuracy_by_bucket, eval_report, hybrid_report, hybrid_report_two_scorers, distractor_examples, distractor_examples_repeated, variants_v3, captured_registry, chat_splits, progress_running, progress_by_date, split_rows, split_rows_one_share,
    split_by_entity, split_entities, limit_then_filter, file_checksum, flagship)}
