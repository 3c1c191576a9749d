"""Selectors: from a query and its candidates to an answer.  A selector takes and returns a DataFrame.

Rows in: qid, query, candidates (rank, cik, name, entity_type, score).  Rows out: the same and answer_name, answer_cik; null where there is none.

qid tells rows apart and is not null.  A null query and an empty list have no answer; of equal candidates the first counts; an empty table gives an empty result, and a report of zeros."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import stored
from .lookup import cascade
from .prompts import templated, user_prompt
from .resolve import by_id_or_name, parsed
from .score import same_name, share

Selector = Callable[[DataFrame], DataFrame]


def first_candidate(found: DataFrame) -> DataFrame:
    first = F.get("candidates", F.lit(0))
    return found.withColumns({"answer_name": first["name"], "answer_cik": first["cik"]})


def rule_matcher(registry: DataFrame, scorers: tuple[str, ...] = ("token_sort", "partial")) -> Selector:
    """Exact lookup, then similarity; candidates are not looked at."""

    def select(found: DataFrame) -> DataFrame:
        hits = cascade(found.select("qid", "query"), registry, scorers=scorers).join(registry.select("ord", F.col("name").alias("answer_name"), F.col("cik").alias("answer_cik")), "ord", "left")
        return found.join(hits.select("qid", "answer_name", "answer_cik"), "qid")

    return select


def model_prompt(query: Column, candidates: Column, system: str | None = None, scores: bool = False) -> Column:
    """What a text model is asked: the user's text alone, or with a system text as chat markup in which its reply follows; with the candidates' scores if asked for."""
    user = user_prompt(query, candidates, scores)
    if system is None:
        return user
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return templated(F.array(message("system", F.lit(system)), message("user", user)))


def model(load: Callable[[], Callable[[list[str]], list[str]]], pause: float = 0.0, system: str | None = None, scores: bool = False) -> Selector:
    """A text model: load() runs once in each Python worker and gives a function from prompts (see model_prompt) to replies.  A reply that raises or holds no
    object is no answer; a worker waits `pause` seconds after each batch of prompts; an id among the candidates wins over the name given, and without one the candidate with the most similar name is taken."""

    def replies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()
        for part in parts:
            try:
                got = ask(part["prompt"].tolist())
            except Exception:
                got = [""] * len(part)
            time.sleep(pause)
            yield pd.DataFrame({"qid": part["qid"], "reply": got})

    def select(found: DataFrame) -> DataFrame:
        asked = found.select("qid", model_prompt(F.col("query"), F.col("candidates"), system, scores).alias("prompt"))
        said = asked.mapInPandas(replies, "qid long, reply string").withColumn("v", parsed(F.col("reply")))
        rows = found.join(said, "qid")
        rows = rows.withColumns({"said_cik": F.try_variant_get("v", "$.cik", "bigint"), "said_name": F.try_variant_get("v", "$.canonical_name", "string")})
        rows = rows.withColumn("hit", by_id_or_name(F.col("candidates"), F.col("said_cik"), F.col("said_name")))
        return rows.withColumns({"answer_name": F.coalesce("hit.name", "said_name"), "answer_cik": F.col("hit.cik")}).drop("v", "reply", "said_cik", "said_name", "hit")

    return select


def routed(name: str, routes: dict[str, Selector], default: Selector) -> Selector:
    """The selector of the first route whose key is part of the model's name, in any case."""
    return next((s for key, s in routes.items() if key.lower() in name.lower()), default)


def hybrid(rows: DataFrame, registry: DataFrame, fallback: Selector | None = None) -> DataFrame:
    """rows: (qid, query, name, difficulty, candidates) -> a row of counts and shares: the rule matcher first, the fallback only for queries without any match.

    hits: found rightly by the matcher; calls: left to the fallback; call_hits: found rightly by it, names compared without regard to case; call_rate is 0 without a fallback."""
    matched = rule_matcher(registry)(rows.select("qid", "query", "candidates")).select("qid", "answer_name", "answer_cik")
    rows = rows.join(matched, "qid").withColumn("hit", F.coalesce(F.col("answer_name") == F.col("name"), F.lit(False)))
    rows = rows.withColumn("call", F.col("answer_cik").isNull() if fallback else F.lit(False))
    if fallback:
        rows = stored(rows.drop("answer_name", "answer_cik"), "matched")
        said = fallback(rows.filter("call").select("qid", "query", "candidates")).select("qid", F.col("answer_name").alias("said"))
        rows = rows.join(said, "qid", "left").withColumn("call_hit", same_name(F.col("name"), F.col("said")) & F.col("call"))
    else:
        rows = rows.withColumn("call_hit", F.lit(False))
    total = F.col("hit") | F.col("call_hit")
    buckets = [c for b in ("hard", "easy") for c in (F.count_if(F.col("difficulty") == b).alias(b), F.count_if(F.col("hit") & (F.col("difficulty") == b)).alias(f"{b}_hits"))]
    shares = {"accuracy": share(F.col("hit")), "accuracy_hard": share(F.col("hit"), F.col("difficulty") == "hard"), "accuracy_easy": share(F.col("hit"), F.col("difficulty") == "easy"), "total_accuracy": share(total), "call_rate": share(F.col("call"))}
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count_if("call").alias("calls"), F.count_if("call_hit").alias("call_hits"), *buckets, *(F.round(c, 9).alias(name) for name, c in shares.items()))
