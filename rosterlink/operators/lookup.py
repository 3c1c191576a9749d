"""Lookup of normalised names, and the cascade: exact first, similarity only for what is left.

A null query finds nothing; null names and null or empty former names are never found.  Repeated names are told apart by ord, and queries are rows of their own, whatever their
qid (null and repeated ones stay as they are); which of equal names wins is said below.  Other columns of the queries go through lookup.exact unchanged, whatever their names, but for norm and ord, which it adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.names import lookup_form, suffix_form, without_noise
from ..functions.similarity import token_sorted
from ..shared import stored
from .search import best_above, best_partial_rows, different, for_each

CASCADE_THRESHOLD = 80.0


def lookup_table(registry: DataFrame) -> DataFrame:
    """(ord, name, former_names) -> (norm, ord): of equal canonical names the last row wins, before any former name; of former names the first.

    Each different text is brought into its form once."""
    names = registry.select("ord", F.lit(0).alias("kind"), F.lit(0).alias("nth"), F.col("name").alias("text"))
    former = registry.select("ord", F.lit(1).alias("kind"), F.posexplode("former_names").alias("nth", "text")).filter("text <> ''")
    first = F.struct("kind", F.when(F.col("kind") == 0, -F.col("ord")).otherwise(F.col("ord")).alias("by"), "nth", "ord")
    texts = stored(names.union(former).filter("text is not null").groupBy("text").agg(F.min(first).alias("m")), "texts")
    forms = stored(texts.select(suffix_form(F.col("text")).alias("norm"), "m"), "forms")  # a join's condition would be pushed into what makes the forms, and repeat it for all rows
    return forms.groupBy("norm").agg(F.min("m").alias("m")).select("norm", "m.ord")


def exact(queries: DataFrame, registry: DataFrame) -> DataFrame:
    """(qid, query, more) -> (norm, qid, query, more, ord): ord is null where nothing fits."""
    kept = [c for c in queries.columns if c not in ("norm", "ord")]
    asked = queries.select(lookup_form(F.col("query")).alias("norm"), F.struct(*kept).alias("row"))
    return asked.join(lookup_table(registry), "norm", "left").select("norm", "row.*", "ord")


def fallback_choices(registry: DataFrame) -> DataFrame:
    """The names as they are, and of the former names that aren't empty the last one: (ord, kind, nth, text)."""
    former = F.try_element_at(F.filter("former_names", lambda f: f != ""), F.lit(-1))
    return registry.select("ord", F.posexplode(F.array("name", former)).alias("kind", "text")).filter("text is not null").select("ord", "kind", F.lit(0).alias("nth"), "text")


def best_by(missed: DataFrame, choices: DataFrame, scorer: str, threshold: float) -> DataFrame:
    """(row, query): the best choice at the threshold or above, by 'ratio', by 'token_sort' or by 'partial' on the query without its noise; of equal ones the first by kind and ord."""
    form = {"ratio": lambda c: c, "token_sort": token_sorted, "partial": without_noise}[scorer]
    asked = stored(missed.select(F.col("row").alias("own"), form(F.col("query")).alias("query")), "missed")
    texts = different(asked.withColumnRenamed("own", "row"))
    found = best_partial_rows(texts, choices, threshold) if scorer == "partial" else best_above(texts, choices, form(F.col("text")), threshold)
    return for_each(asked, texts, "own").join(found, "row").select(F.col("own").alias("row"), "ord", "kind", "nth", "score")


def cascade(queries: DataFrame, registry: DataFrame, threshold: float = CASCADE_THRESHOLD, scorers: tuple[str, ...] = ("token_sort", "partial")) -> DataFrame:
    """(qid, query) -> (qid, ord, how, score): how is 'exact', 'similar' or null.  Of equal scores the first scorer's wins."""
    tried = stored(exact(queries.select("qid", "query"), registry).withColumn("row", F.monotonically_increasing_id()), "tried")  # read by both branches; the numbers stay as they are
    hits = tried.filter("ord is not null").select("qid", "ord", F.lit("exact").alias("how"), F.lit(100.0).alias("score"))
    missed = tried.filter("ord is null").select("row", "qid", "query")
    choices = stored(fallback_choices(registry), "names")
    found = None
    for nth, name in enumerate(scorers):
        part = best_by(missed, choices, name, threshold).withColumn("scorer", F.lit(nth))
        found = part if found is None else found.union(part)
    best = found.withColumn("place", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "scorer", "kind", "ord"))).filter("place = 1")
    similar = missed.join(best.filter(F.col("score") >= threshold), "row", "left")
    return hits.union(similar.select("qid", "ord", F.when(F.col("ord").isNotNull(), "similar").alias("how"), "score"))
