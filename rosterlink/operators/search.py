"""The similarity join: for each query the most similar registry names, exactly.

Different texts meet once: equal queries are asked once, and equal names are scored once.  A text stands for the rows that have it, of which the first few, or for a threshold all, come back after that.

Best matches: queries and choices are dealt into blocks; each pair of blocks is scored by one task, so neither side has to fit in one place and
nothing is broadcast.  A task hands on, for each query, the rows that may be among its best; ties are settled after that.
Of a registry of many blocks, which are then ranges of lengths, each query first meets one with texts of its own length.  What it finds there bounds its best matches from below: it goes only to
blocks whose lengths and character counts allow such a score, and there only texts that allow it are scored and handed on.
Matches above a high threshold: both sides meet on the rarest pairs of characters (see grams); only short texts meet in blocks.  Below INDEX_FROM two texts need share so few
pairs that nearly all would meet on some key, and blocks are cheaper; results are the same.

Queries are rows: each is numbered when it comes in, so keys of any type, null keys and repeated ones are kept apart and handed back as they are.
A null query finds nothing and a null name is never found; an empty query is a text like any other.  Repeated names are choices of their own, told apart by
ord.  Equal scores are ordered by ord, then by the place of the name in its row.  Other columns of the inputs are not read.  An empty side gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import basic_form
from ..functions.similarity import BINS, Choices, points_of, ratio, token_sorted
from ..shared import stored
from .grams import FOUND, short_size, within

QUERY_BLOCK, CHOICE_BLOCK = 4096, 1 << 14
WIDE = 4  # so many blocks of choices are one where all queries meet all choices: texts share more, and one list of the best is found
LEAST_QUERIES = 32
SHARES = 8
INDEX_FROM = 90.0
ROUNDS_FROM = 8  # blocks of choices from which on there are two rounds
LONGEST = 4096  # longer texts count as of this length when blocks are made
BY_KIND = "kind", "ord", "nth"
MOST_BLOCKS = 1 << 17  # a summary of each, some MB in all, goes to every task


def numbered(queries: DataFrame, text: Column) -> DataFrame:
    """(qid, query) -> (row, qid, query), written, the query in the form given."""
    return stored(queries.select(F.monotonically_increasing_id().alias("row"), "qid", text.alias("query")), "queries")  # the numbers stay as they are


def different(asked: DataFrame) -> DataFrame:
    """(row, query) -> (query, row): each text that is asked, once, under the first of its numbers."""
    return stored(asked.filter("query is not null").groupBy("query").agg(F.min("row").alias("row")), "asked")


def for_each(asked: DataFrame, texts: DataFrame, *kept: str) -> DataFrame:
    """Numbered queries with the number of their text: (row, kept)."""
    return asked.select("query", *kept).join(texts, "query").drop("query")


def named(found: DataFrame, asked: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of different texts with the keys of all queries that ask for them."""
    return for_each(asked, texts, "qid").join(found, "row").drop("row")


def held_by(rows: DataFrame, by: list[str], order: tuple[str, ...], most: int) -> DataFrame:
    """(ord, kind, nth, by) -> (by, held): what `by` says once, with the first rows in that order that say it, `most` at the most."""
    row = F.struct("ord", "kind", "nth")
    if most == 1:
        return rows.groupBy(*by).agg(F.array(F.min_by(row, F.struct(*order))).alias("held"))
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= most).groupBy(*by).agg(F.collect_list(row).alias("held"))


def firsts(choices: DataFrame, order: tuple[str, ...], most: int, form: Column | None = None) -> DataFrame:
    """(ord, kind, nth, text) -> (number, text, n, held): each text once, with the first rows in that order that have it, `most` at the most, and how many these are.

    form: choices have texts as they come, and maybe other columns, of which the text is made: once for all rows that are alike, not for each."""
    rows = choices.filter("text is not null")
    if form is not None:
        alike = held_by(rows, [c for c in choices.columns if c not in ("ord", "kind", "nth")], order, most)
        formed = stored(alike.select(form.alias("text"), "held"), "forms")  # a filter before that would repeat what makes the texts
        rows = formed.filter("text is not null").select("text", F.explode("held").alias("h")).select("text", "h.*")
    texts = held_by(rows, ["text"], order, most)
    return stored(texts.select(F.monotonically_increasing_id().alias("number"), "text", F.size("held").alias("n"), "held"), "texts")  # the numbers stay as they are


def as_choices(texts: DataFrame, *more: str) -> DataFrame:
    """Numbered texts in the form of choices."""
    return texts.select(F.col("number").alias("ord"), F.lit(0).alias("kind"), F.lit(0).alias("nth"), "text", *more)


def all_rows(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, ord, score), ord the number of a text -> FOUND of the rows held for it."""
    rows = found.select("row", "score", F.col("ord").alias("number")).join(texts.select("number", "held"), "number").select("row", "score", F.explode("held").alias("h"))
    return rows.select("row", "h.ord", "h.kind", "h.nth", "score")


def laid_out(asked: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides without nulls, the choices written: they are counted, then read."""
    return asked.select("row", "query").filter("query is not null"), stored(choices.select("ord", "kind", "nth", "text"), "choices").filter("text is not null")  # a filter before that would repeat what makes the texts


def block_pairs(queries: DataFrame, choices: DataFrame, task) -> DataFrame:
    """Each block of queries meets each block of choices."""
    n_queries, n_choices = queries.count(), choices.count()
    nc = max(1, -(-n_choices // (WIDE * CHOICE_BLOCK)))
    spread = -(-SHARES * queries.sparkSession.sparkContext.defaultParallelism // nc)  # few blocks: smaller ones, for all cores, and several for each, as they are dealt by hash
    nq = max(1, -(-n_queries // QUERY_BLOCK), min(spread, n_queries // LEAST_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq)).cast("long")).withColumn("cb", every(nc))
    right = choices.withColumn("cb", F.pmod(F.xxhash64("ord", "kind", "nth"), F.lit(nc)).cast("long")).withColumn("qb", every(nq))
    n = min(1 << 16, nq * nc)  # by number: small in bytes, heavy in work, so not to be coalesced
    left, right = left.repartition(n, "qb", "cb"), right.repartition(n, "qb", "cb")
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(task, FOUND)


def scoring(best):
    """A task over a pair of blocks; best(choices laid out, queries) gives numbers of queries, rows and their scores."""

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        which, rows, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            held = Choices(right["text"].to_pylist(), right["n"].to_numpy() if "n" in right.column_names else None)
            which, rows, scores = best(held, left)
        at = pa.array(rows, pa.int64())
        return pa.table({"row": left["row"].take(pa.array(which, pa.int64())), **{c: right[c].take(at) for c in ("ord", "kind", "nth")}, "score": pa.array(scores, pa.float64())})

    return task


def best_of(at_least: int, least: float = -1.0):
    """scoring's best matches; queries may know a least score of their own."""

    def best(held: Choices, left: pa.Table):
        known = left["least"].to_numpy() if "least" in left.column_names else np.full(left.num_rows, least)
        return held.best_of(left["query"].to_pylist(), at_least, known)

    return best


def scored(asked: DataFrame, choices: DataFrame, at_least: int, order: tuple[str, ...] = ("ord", "kind", "nth"), least: float = -1.0, form: Column | None = None) -> DataFrame:
    """(row, query), texts that differ, and (ord, kind, nth, text), of which form, if any, makes the text that is searched (see firsts) -> (row, ord, kind, nth, score): the best `at_least` of each query, of equal scores the first in that order, and others; those below the least score may be missing."""
    queries = asked.select("row", "query").filter("query is not null")
    texts = firsts(choices, order, at_least, form)
    if ROUNDS_FROM * CHOICE_BLOCK > texts.count():
        found = block_pairs(queries, as_choices(texts, "n"), scoring(best_of(at_least, least)))
    else:
        found = in_two_rounds(queries, as_choices(texts, "n"), at_least)[0]
    return all_rows(found, texts)


def best_above(asked: DataFrame, choices: DataFrame, form: Column, least: float) -> DataFrame:
    """(row, query), texts that differ -> the best one of each query, if it is of the least score or more: of equal ones the first by kind and ord."""
    return first_of(scored(asked, choices, 1, BY_KIND, least, form).filter(F.col("score") >= least))


def first_of(found: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), *BY_KIND))
    return found.withColumn("place", place).filter("place = 1").drop("place")


def by_length(choices: DataFrame) -> tuple[list[int], list[int]]:
    """For each length up to LONGEST the first of its blocks, and how many it has: rare lengths share a block with their neighbours, a frequent one has several."""
    counts = {r["n"]: r["count"] for r in choices.groupBy(F.least(F.length("text"), F.lit(LONGEST)).alias("n")).count().collect()}  # LONGEST rows and one, at most
    first, ways, block, held = [], [], 0, 0
    for n in range(LONGEST + 1):
        rows = counts.get(n, 0)
        if held and held + rows > CHOICE_BLOCK:
            block, held = block + 1, 0
        first.append(block)
        ways.append(max(1, -(-rows // CHOICE_BLOCK)))
        block, held = (block + ways[-1], 0) if ways[-1] > 1 else (block, held + rows)
    return first, ways


def summaries(choices: DataFrame) -> list:
    """(cb, text) -> a row for each block: its shortest and its longest text, and the most characters of each class in one of them."""

    def run(batches):
        for batch in batches:
            block, held = batch.column(0).to_numpy(), Choices(batch.column(1).to_pylist())
            order = np.argsort(block, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else order
            counts = held.counts.reshape(-1, BINS, len(held.texts)).sum(axis=0)  # of fewer classes
            most = np.maximum.reduceat(counts[:, order], starts, axis=1).T.astype(np.int32) if len(order) else np.empty((0, BINS), np.int32)
            size = held.sizes[order]
            low, high = (f.reduceat(size, starts) if len(order) else size for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][starts]), pa.array(low), pa.array(high), pa.ListArray.from_arrays(pa.array(np.arange(len(most) + 1) * BINS, pa.int32()), pa.array(most.ravel()))], names=["cb", "low", "high", "most"])

    rows = choices.select("cb", "text").mapInArrow(run, "cb long, low long, high long, most array<int>")
    return rows.groupBy("cb").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array(*(F.max(F.get("most", F.lit(i))) for i in range(BINS))).alias("most")).collect()


def in_two_rounds(queries: DataFrame, choices: DataFrame, at_least: int) -> tuple[DataFrame, DataFrame]:
    """As scored, and the queries with the blocks that each goes to in the second round (row, query, least, cbs)."""
    first, ways = by_length(choices)
    nb = first[-1] + ways[-1]
    if nb > MOST_BLOCKS:
        return block_pairs(queries, choices, scoring(best_of(at_least))), queries
    spread = queries.sparkSession.sparkContext.defaultParallelism
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), F.least(n, F.lit(LONGEST))).cast("long")
    own = lambda text, *key: at(first, F.length(text)) + F.pmod(F.xxhash64(*key), at(ways, F.length(text)))
    choices = stored(choices.withColumn("cb", own("text", "ord", "kind", "nth")), "blocks")
    nq = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = lambda rows, *by: rows.repartition(max(spread, min(1 << 16, nb * nq)), *by).groupBy(*by)
    both = choices.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<long>")))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(nq)).cast("long"))
    seeds = asked.withColumn("cb", own("query", "row")).withColumn("least", F.lit(-1.0))
    found = stored(dealt(seeds, "qb", "cb").cogroup(dealt(both, "qb", "cb")).applyInArrow(scoring(best_of(at_least)), FOUND), "found")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score")))
    least = found.withColumn("place", place).filter(F.col("place") == at_least).select("row", F.col("score").alias("least"))
    blocks = sorted(summaries(choices), key=lambda r: r["cb"])
    number, low, high = (np.array([r[c] for r in blocks], np.int64) for c in ("cb", "low", "high"))
    most = np.array([r["most"] for r in blocks], np.int64).reshape(len(blocks), BINS)

    def routed(batches):
        for batch in batches:
            cbs = []
            for text, lower, seed in zip(*(batch.column(c).to_pylist() for c in ("query", "least", "cb")), strict=True):
                common = np.minimum(np.minimum(most, np.bincount(points_of([text])[0] % BINS, minlength=BINS)).sum(axis=1), high)
                bounds = ratio(common, len(text), np.maximum(low, common))  # the shortest text that may have so much in common
                cbs.append(number[(bounds >= lower) & (number != seed)].tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "query", "qb", "least")), pa.array(cbs, pa.list_(pa.int64()))], names=["row", "query", "qb", "least", "cbs"])

    known = seeds.drop("least").join(least, "row", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    routes = stored(known.select("row", "query", "qb", "least", "cb").mapInArrow(routed, "row long, query string, qb long, least double, cbs array<long>"), "routes")
    second = routes.withColumn("cb", F.explode("cbs")).drop("cbs")
    rest = dealt(second, "qb", "cb").cogroup(dealt(both, "qb", "cb")).applyInArrow(scoring(best_of(at_least)), FOUND)
    return found.union(rest), routes


def scored_above(asked: DataFrame, choices: DataFrame, threshold: float, index_from: float = INDEX_FROM) -> DataFrame:
    """All pairs at the threshold or above."""
    queries, choices = laid_out(asked, choices)
    most = short_size(threshold) if threshold >= index_from else None

    def above(held: Choices, left: pa.Table):
        return held.above(left["query"].to_pylist(), threshold)

    if most is None:
        return block_pairs(queries, choices, scoring(above))
    short = block_pairs(queries.filter(F.length("query") < most), choices.filter(F.length("text") < most), scoring(above))
    # a pair of two short texts may come from both
    return within(queries, choices, threshold).union(short).groupBy("row", "ord", "kind", "nth").agg(F.max("score").alias("score"))


def names_of(registry: DataFrame) -> DataFrame:
    """(ord, name, former_names) -> (ord, kind, nth, text): the name, and the last former name that isn't empty, as they come."""
    former = F.try_element_at(F.filter("former_names", lambda f: f != ""), F.lit(-1))
    return registry.select("ord", F.posexplode(F.array("name", former)).alias("kind", "text")).select("ord", "kind", F.lit(0).alias("nth"), "text")


def searched(text: Column, former: Column) -> Column:
    """What is searched of a name, and of a former one: that is lower-cased only."""
    return token_sorted(F.when(former, F.lower(text)).otherwise(basic_form(text)))


def choices_of(registry: DataFrame) -> DataFrame:
    """(ord, name, former_names) -> (ord, kind, nth, text): the searched form of the name and of the last former name that isn't empty."""
    return names_of(registry).withColumn("text", searched(F.col("text"), F.col("kind") > 0))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(row, ord, score) -> the k best registry rows of each query, ties in registry order, with rank from 1."""
    best = found.groupBy("row", "ord").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "ord"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """(qid, query) and (ord, name, former_names) -> (qid, rank, ord, score)."""
    asked = numbered(queries, token_sorted(basic_form(F.col("query"))))
    texts = different(asked)
    choices = names_of(registry).withColumn("former", F.col("kind") > 0)
    return named(ranked(scored(texts, choices, 2 * k, form=searched(F.col("text"), F.col("former"))), k), asked, texts)


def top_k_all_former(queries: DataFrame, registry: DataFrame, k: int) -> DataFrame:
    """The older form: texts as they are, all former names, the best 2k rows before one for each registry row is kept."""
    names = F.concat(F.array("name"), F.coalesce(F.filter("former_names", lambda f: f != ""), F.array().cast("array<string>")))
    choices = registry.select("ord", F.lit(0).alias("kind"), F.posexplode(names).alias("nth", "text"))
    asked = numbered(queries, token_sorted(F.col("query")))
    texts = different(asked)
    found = scored(texts, choices, 2 * k, form=token_sorted(F.col("text")))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "ord", "nth"))
    first = found.withColumn("place", place).filter(F.col("place") <= 2 * k).groupBy("row", "ord").agg(F.min("place").alias("place"), F.max("score").alias("score"))
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy("place"))).filter(F.col("rank") <= k).drop("place")
    return named(best, asked, texts)


def above(queries: DataFrame, registry: DataFrame, threshold: float) -> DataFrame:
    """(qid, ord, score) of all registry rows at the threshold or above.

    Registry rows with the same names are a class.  Different texts meet, a class has the best score of its texts, and each query gets the rows of its classes: only that last step is as large as the result."""
    asked = numbered(queries, token_sorted(basic_form(F.col("query"))))
    texts = different(asked)
    rows = names_of(registry).filter("text is not null").groupBy("ord").agg(F.array_sort(F.collect_set(F.struct("text", (F.col("kind") > 0).alias("former")))).alias("texts"))
    rows = stored(rows, "rows")
    classes = rows.groupBy("texts").agg(F.min("ord").alias("class"))
    classes = stored(classes.withColumn("forms", F.array_distinct(F.transform("texts", lambda t: searched(t["text"], t["former"])))), "classes")  # made once for all rows that are alike
    parts = classes.select("class", F.explode("forms").alias("text")).filter("text is not null")
    names = stored(parts.select("text").distinct().withColumn("number", F.monotonically_increasing_id()), "names")
    found = scored_above(texts, as_choices(names), threshold).select("row", F.col("ord").alias("number"), "score")
    met = found.join(names, "number").join(parts, "text").groupBy("row", "class").agg(F.max("score").alias("score"))
    return named(met.join(rows.join(classes, "texts").select("class", "ord"), "class").drop("class"), asked, texts)


def best_partial_rows(asked: DataFrame, choices: DataFrame, least: float = -1.0) -> DataFrame:
    """(row, query), texts that differ -> the best one of each query by the partial ratio, if it is of the least score or more."""

    def best(held: Choices, left: pa.Table):
        found = [held.best_partial(query, least) for query in left["query"].to_pylist()]
        sizes = [len(rows) for rows, _ in found]
        return np.repeat(np.arange(len(found)), sizes), np.concatenate([rows for rows, _ in found]), np.repeat([score for _, score in found], sizes)

    queries = asked.select("row", "query").filter("query is not null")
    texts = firsts(choices, BY_KIND, 1)
    return first_of(all_rows(block_pairs(queries, as_choices(texts), scoring(best)), texts))


def best_partial(queries: DataFrame, choices: DataFrame) -> DataFrame:
    """(qid, query) and (ord, kind, nth, text) -> (qid, ord, kind, nth, score): the best partial ratio, the first of equal ones by kind, ord and nth."""
    asked = numbered(queries, F.col("query"))
    texts = different(asked)
    return named(best_partial_rows(texts, choices), asked, texts)
