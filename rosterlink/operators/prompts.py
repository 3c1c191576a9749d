"""Prompts, answers and chat examples.

A null query, candidate name or id makes the whole prompt null, except where a text says that nothing was found; null values of an answer are written as null.  Candidates stand in the order given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSTEM_PLAIN = "Resolve the company name to its registered entity. Reply with one JSON object: canonical_name, cik, entity_type, is_former_name_input."
SYSTEM_RETRIEVAL = "Resolve the company name to one of the listed candidates. Reply with one JSON object: canonical_name, cik, entity_type, is_former_name_input; copy name and cik from the list."
SYSTEM_LISTED = "One of the listed candidates is the company that is meant. Reply with one JSON object: canonical_name, cik, entity_type, is_former_name_input; take all values from that candidate."
SYSTEM_SCORED = "Choose among candidates that a search has found, each with its score. Reply with one JSON object: canonical_name, cik, entity_type, is_former_name_input."
SYSTEM_SHORT = "Which registered company is meant? Reply with JSON only."
NO_CANDIDATES = "(No close matches found in the registry.)"


def candidate_lines(candidates: Column, scores: bool = False) -> Column:
    """Numbered lines of the candidates (name, cik, score), with the rounded score if asked for.  Fixed values: the lines' format."""
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit('. canonical_name: "'), c["name"], F.lit('"  cik: '), c["cik"].cast("string"), *([F.lit(" (score: "), F.bround(c["score"], 0).cast("int").cast("string"), F.lit(")")] if scores else []))
    return F.array_join(F.transform(candidates, line), "\n")


def bracketed_lines(candidates: Column) -> Column:
    """The lines' format."""
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["name"], F.lit(" | CIK: "), c["cik"].cast("string"), F.lit(" | Type: "), c["entity_type"])
    return F.array_join(F.transform(candidates, line), "\n")


def user_prompt(query: Column, candidates: Column, scores: bool = False) -> Column:
    listed = F.when(F.size(candidates) == 0, NO_CANDIDATES).otherwise(candidate_lines(candidates, scores))
    return F.concat(F.lit('Company name: "'), query, F.lit('"\n\nCandidates:\n'), listed)


def listed_prompt(query: Column, candidates: Column) -> Column:
    """The prompt of examples with drawn candidates."""
    return F.concat(F.lit("Company name: "), query, F.lit("\n\nOne of these is meant:\n"), bracketed_lines(candidates))


def first_lines(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def answer(name: Column, cik: Column, entity_type: Column, former: Column) -> Column:
    """The answer as compact JSON; missing values are written as null."""
    row = F.struct(name.alias("canonical_name"), cik.alias("cik"), entity_type.alias("entity_type"), former.alias("is_former_name_input"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def chat(system: str, user: Column, reply: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(system)), message("user", user), message("assistant", reply))


def templated(messages: Column, reply_follows: bool = True) -> Column:
    """Messages as one text in the usual chat markup; the start of a reply at its end if one is to follow."""
    each = F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n")))
    return F.concat(F.array_join(each, ""), F.lit("<|im_start|>assistant\n" if reply_follows else ""))


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def padded_id(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")
