"""From a model's reply to a registry row: parse, then look among the candidates.

Null replies, null candidates and empty lists of them give null.  Of equally similar candidates the first is taken; candidates with a null name are never similar, and repeated ones
stand where they are.  Rows don't depend on one another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.names import strip
from ..functions.similarity import pair_ratios, sort_tokens

NAME_THRESHOLD, REPLY_THRESHOLD = 70.0, 75.0


def json_part(reply: Column) -> Column:
    """The text from the first opening to the last closing brace, without code fences; null without any."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def parsed(reply: Column) -> Column:
    """The reply's object as a variant; null without one.  Inside an array, as the parser alone lets text behind an object pass.

    An object that says a key twice, or NaN or an infinity, is no JSON to the parser and gives null: such a reply is ambiguous and counts as no answer."""
    v = F.try_parse_json(F.concat(F.lit("["), json_part(reply), F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def by_id(candidates: Column, cik: Column) -> Column:
    """The first candidate with that id (compared as numbers); null if there is none."""
    return F.try_element_at(F.filter(candidates, lambda c: c["cik"] == cik), F.lit(1))


def places(parts: Iterator[tuple[pd.Series, pd.Series]], fits: Callable[[float], bool]) -> Iterator[pd.Series]:
    """The place, from 1, of the first of the texts that are most similar to the one given; null if none of them fits."""
    for texts, text in parts:
        pairs = [(i, k, own, t) for i, (ts, own) in enumerate(zip(texts, text, strict=True)) if own is not None and ts is not None for k, t in enumerate(ts) if t is not None]
        scores = pair_ratios([sort_tokens(own) for _, _, own, _ in pairs], [sort_tokens(t) for _, _, _, t in pairs])
        best: dict[int, tuple[float, int]] = {}
        for (i, k, _, _), score in zip(pairs, scores, strict=True):
            if fits(score) and (i not in best or score > best[i][0]):
                best[i] = score, k + 1
        yield pd.Series([best[i][1] if i in best else None for i in range(len(text))], dtype="Int32")


@F.pandas_udf(IntegerType())
def nearest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from places(parts, lambda score: score >= NAME_THRESHOLD)


@F.pandas_udf(IntegerType())
def above(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    yield from places(parts, lambda score: score > REPLY_THRESHOLD)


def by_id_or_name(candidates: Column, cik: Column, name: Column) -> Column:
    """The candidate with that id, else the one whose name, lower-cased, is most similar; null if there is none."""
    hit = by_id(candidates, cik)
    place = nearest(F.transform(candidates, lambda c: F.lower(c["name"])), F.when(hit.isNull(), F.lower(name)))
    return F.coalesce(hit, F.get(candidates, place - 1))


def plain(name: Column) -> Column:
    return strip(F.replace(F.replace(F.lower(name), F.lit(","), F.lit("")), F.lit("."), F.lit("")))


def by_name(candidates: Column, said: Column) -> Column:
    """The first candidate that equals a reply up to case, commas and points, else the most similar one if it is above 75; null if there is none."""
    out = plain(said)
    same = F.try_element_at(F.filter(candidates, lambda c: plain(c["name"]) == out), F.lit(1))
    place = above(F.transform(candidates, lambda c: F.lower(c["name"])), F.when(same.isNull(), out))
    return F.coalesce(same, F.get(candidates, place - 1))
