"""Random draws that depend on a key and a salt, not on the order of rows: the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(salt: str, *key: Column) -> Column:
    """A number from 0 to below 1: the first 32 bits of the md5 of the key and the salt."""
    text = F.concat_ws("|", *(k.cast("string") for k in key), F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def pick(u: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))
