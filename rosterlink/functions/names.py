"""Company names as expressions: ordered rule tables for cleaning, keyed draws for noise.

Every function gives null for a null name and takes an empty one like any other; rows don't depend on one another, so ties, repeats and empty tables need no rule.  White space is of all kinds
(as Python's), not that of ASCII alone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import compiled
from .draws import pick, uniform

# Endings in the order in which they are tried, each with what may stand for it.
SUFFIXES = {
    "incorporated": ["Inc.", "Inc", "INC", "Incorporated"],
    "inc.": ["Inc", "INC", "Incorporated", "Inc."],
    "inc": ["Inc.", "INC", "Incorporated"],
    "corporation": ["Corp.", "Corp", "CORP", "Corporation"],
    "corp.": ["Corp", "CORP", "Corporation", "Corp."],
    "corp": ["Corp.", "CORP", "Corporation"],
    "company": ["Co.", "Co", "CO", "Company"],
    "co.": ["Co", "CO", "Company", "Co."],
    "limited liability company": ["LLC", "L.L.C.", "Llc"],
    "llc": ["L.L.C.", "Llc", "LLC"],
    "limited": ["Ltd.", "Ltd", "LTD", "Limited"],
    "ltd.": ["Ltd", "LTD", "Limited", "Ltd."],
    "holdings": ["Holdings", "Hldgs", "HOLDINGS"],
    "group": ["Group", "Grp", "GROUP"],
    "l.p.": ["LP", "L.P.", "Limited Partnership"],
    "plc": ["PLC", "Public Limited Company", "plc"],
    "n.v.": ["N.V.", "NV", "Naamloze Vennootschap"],
}
# The same table as the retrieval data set has it.
RETRIEVAL_SUFFIXES = SUFFIXES | {"holdings": ["Holdings", "Holdings", "HOLDINGS"]}

# Texts around a name.
WRAPPERS = [
    "{name}",
    "{name}.",
    "{name},",
    "  {name}  ",
    "{name} (fka)",
    "{name} - formerly known as",
    "dba {name}",
    "{name}, the Company",
    '{name} (the "Company")',
    "{name} (successor to former entity)",
    "{name} /DE/",
    "{name}, a Delaware corporation",
    "{name} /formerly/",
]
LIGHT_WRAPPERS = ["{name}", "{name}.", "{name},", "  {name}  "]

# What is cut out of a name, in order, without regard to case.
NOISE_RULES = [
    r"\s*\(fka\)\s*",
    r'\s*\(the\s*"?Company"?\)\s*',
    r'\s*,\s*the\s*"?Company"?\s*$',
    r"\s*-\s*formerly\s+known\s+as\s*$",
    r"\s*\(successor\s+to\s+former\s+entity\)\s*",
    r"\s*/DE/\s*",
    r"\s*,\s*a\s+Delaware\s+corporation\s*",
    r"\s*/formerly/\s*",
    r"^dba\s+",
    r"^f/k/a\s+",
    r"^formerly\s+",
    r"\.$",
    r"\.\s*$",
]

# Rewrites of a lower-cased name, in order.
SUFFIX_RULES = [
    (r"\s+and\s+", " & "),
    (r"\s*&\s*", " & "),
    (r"\bpublic\s+limited\s+company\b", "plc"),
    (r"\binc(orporated)?\.?\b", "inc"),
    (r"\bcorp(oration)?\.?\b", "corp"),
    (r"\bco(mpany)?\.?\b", "co"),
    (r"\bllc\.?\b", "llc"),
    (r"\bl\.?l\.?c\.?\b", "llc"),
    (r"\bltd\.?\b", "ltd"),
    (r"\blimited\b", "ltd"),
    (r"\bplc\.?\b", "plc"),
    (r"\bl\.?p\.?\b", "lp"),
    (r"\bholdings\.?\b", "holdings"),
    (r"\bgroup\.?\b", "group"),
    (r"\bn\.?v\.?\b", "nv"),
    (r"\bban,?\s*corp\b", "bancorp"),
    (r"\bs\.?a\.?\b", "sa"),
    (r"[,.&]", ""),
    (r"\s+", " "),
]
# The endings before which a comma may go.
COMMA_RULE = r",\s*(Inc\.?|Corp\.?|Ltd\.?|LLC|L\.L\.C\.|PLC|Co\.?|LP|L\.P\.|N\.V\.)\b"

# An ampersand and what may stand for it.
AND_RULE = r"\s*&\s*"
JOINERS = [" & ", " and ", " AND "]


# All kinds of white space; \s alone is that of ASCII.
WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"


def wide(rule: str) -> str:
    """A rule whose white space is of all kinds."""
    return rule.replace(r"\s", WHITE)


def strip(text: Column) -> Column:
    """Without white space at either end, all kinds of it."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def filled(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("unknown"))


def basic_form(name: Column) -> Column:
    """The form in which names are searched."""
    plain = F.replace(F.replace(strip(F.lower(name)), F.lit(","), F.lit("")), F.lit("."), F.lit(""))
    return F.regexp_replace(F.replace(plain, F.lit(" & "), F.lit(" and ")), f"{WHITE}+", " ")


def without_noise(name: Column) -> Column:
    for rule in NOISE_RULES:
        name = F.regexp_replace(name, f"(?i){wide(rule)}", "")
    return strip(name)


def suffix_form(name: Column) -> Column:
    """The form in which names are looked up."""
    name = strip(F.lower(name))
    for rule, to in SUFFIX_RULES:
        name = F.regexp_replace(name, f"(?i){wide(rule)}", to)
    return strip(name)


def lookup_form(name: Column) -> Column:
    return suffix_form(without_noise(name))


def without_comma(name: Column) -> Column:
    return F.regexp_replace(name, f"(?i){wide(COMMA_RULE)}", " $1")


def title(name: Column) -> Column:
    """A capital after anything that is not a letter.  A character U+0001 before a space is dropped."""
    return F.replace(F.initcap(F.regexp_replace(name, r"(?<=\P{L})(?=\p{L})", "\x01 ")), F.lit("\x01 "), F.lit(""))


def swapped(name: Column, choice: Column, gap: Column, table: dict[str, list[str]] = SUFFIXES) -> Column:
    """The name with its ending, if the table has it, in another form; choice and gap are draws.

    Looking back from the end finds the shortest ending first; that is the first one of the table as long as no ending there comes before a shorter one that it ends with."""
    keys = list(table)
    if any(b.endswith(a) for i, b in enumerate(keys) for a in keys[i + 1 :] if a != b):
        raise ValueError("an ending comes before a shorter one that it ends with")
    key = F.regexp_extract(F.lower(name), rf"\z(?<=({'|'.join(map(re.escape, keys))}))", 1)
    forms = F.try_element_at(F.create_map(*(x for k, values in table.items() for x in (F.lit(k), F.array(*map(F.lit, values))))), key)
    base = F.rtrim(F.substring(name, F.lit(1), F.length(name) - F.length(key)), F.lit(", "))
    form = F.get(forms, F.floor(choice * F.size(forms)).cast("int"))
    return F.coalesce(F.concat(base, pick(gap, [" ", ", "]), form), name)


def recased(name: Column, u: Column) -> Column:
    return F.when(u < 0.25, F.upper(name)).when(u < 0.45, F.lower(name)).when(u < 0.55, title(name)).otherwise(name)


def repunctuated(name: Column, joiner: Column, commas: Column, spaces: Column) -> Column:
    name = F.regexp_replace(name, F.lit(wide(AND_RULE)), pick(joiner, JOINERS))
    name = F.when(commas < 0.3, F.replace(name, F.lit(","), F.lit(""))).otherwise(name)
    return F.when(spaces < 0.2, F.regexp_replace(name, f"{WHITE}+", "  ")).otherwise(name)


def wrapped(name: Column, u: Column, wrappers: list[str] = WRAPPERS) -> Column:
    return strip(F.replace(pick(u, wrappers), F.lit("{name}"), name))


def with_messy(rows: DataFrame, name: str, *key: Column, to: str = "messy") -> DataFrame:
    """Adds a noisy form and, as kinds, how many kinds of noise were tried.

    Each step is a column of its own: an expression that uses the step before several times would double it each time."""
    compiled(rows.sparkSession)
    u = lambda salt: uniform(salt, *key)
    a, b, c = u("swap?") < 0.85, u("points?") < 0.5, u("case?") < 0.4
    text = F.col(to)
    rows = rows.withColumn(to, F.when(a, swapped(F.col(name), u("swap"), u("gap"))).otherwise(F.col(name)))
    rows = rows.withColumn(to, F.when(b, F.regexp_replace(text, F.lit(wide(AND_RULE)), pick(u("joiner"), JOINERS))).otherwise(text))
    rows = rows.withColumn(to, F.when(b & (u("commas") < 0.3), F.replace(text, F.lit(","), F.lit(""))).otherwise(text))
    rows = rows.withColumn(to, F.when(b & (u("spaces") < 0.2), F.regexp_replace(text, f"{WHITE}+", "  ")).otherwise(text))
    rows = rows.withColumn(to, F.when(c, recased(text, u("case"))).otherwise(text))
    return rows.withColumn(to, wrapped(text, u("wrapper"))).withColumn("kinds", a.cast("int") + b.cast("int") + c.cast("int"))
