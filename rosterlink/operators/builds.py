"""Whole data sets: from a registry to chat examples in named splits.

Each takes a registry (cik, name, entity_type, former_names, ord) and gives rows (messages, difficulty, split); sinks.write_splits writes them.  A seed gives other draws; the
same seed gives the same rows, for any partitioning.  Rows without a name make no examples.  Equal examples stay.  Columns of the registry other than those named are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import datasets, prompts
from .splits import split_rows


def in_splits(examples: DataFrame, key: list[str], system: str, user: Column, shares: dict[str, float], least: int, seed: int | None) -> DataFrame:
    answer = prompts.answer(F.col("canonical_name"), F.col("cik"), F.col("entity_type"), F.col("is_former"))
    rows = examples.select(F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("key"), prompts.chat(system, user, answer).alias("messages"), "difficulty")
    return split_rows(rows, "key", "split" if seed is None else f"split|{seed}", shares, least).drop("key")


def plain_chats(registry: DataFrame, seed: int | None = None) -> DataFrame:
    """Noisy inputs alone: a tenth each for test and validation, 50 at least."""
    return in_splits(datasets.first_examples(registry, seed=seed), ["cik", "branch", "variant"], prompts.SYSTEM_PLAIN, F.col("input"), {"test": 0.1, "valid": 0.1}, 50, seed)


def second_chats(registry: DataFrame, held: DataFrame, seed: int | None = None) -> DataFrame:
    """The second data set, without the inputs held out: 12 % for validation, 100 at least."""
    return in_splits(datasets.second_examples(registry, held, seed), ["cik", "branch", "variant"], prompts.SYSTEM_PLAIN, F.col("input"), {"valid": 0.12}, 100, seed)


def distractor_chats(registry: DataFrame, k: int = 5, seed: int | None = None) -> DataFrame:
    """Noisy inputs, each with k drawn candidates: a tenth each for test and validation, 50 at least."""
    examples = datasets.distractor_examples(registry, k, seed)
    return in_splits(examples, ["ord", "branch", "variant"], prompts.SYSTEM_LISTED, prompts.listed_prompt(F.col("input"), F.col("candidates")), {"test": 0.1, "valid": 0.1}, 50, seed)


def retrieval_chats(registry: DataFrame, held: DataFrame, examples: int = 5, k: int = 5, seed: int | None = None) -> DataFrame:
    """Noisy inputs with the candidates that the search finds, for companies whose cik is not in held: 15 % for validation, 100 at least."""
    rows = datasets.retrieval_examples(registry, datasets.without_ciks(registry, held), examples, k, seed)
    return in_splits(rows, ["cik", "attempt"], prompts.SYSTEM_RETRIEVAL, prompts.user_prompt(F.col("query"), F.col("candidates")), {"valid": 0.15}, 100, seed)
