"""What the corpus operators share: row ids, Arrow batches, components."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder, stored

__all__ = ["bounded_batches", "components", "quiet_tokenizers", "shared_folder", "small_table", "stored", "unique_ids"]
BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
MOST_SMALL = 1_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, by bytes as well as by rows: a batch of very long
    texts would not fit in a worker otherwise."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows held by the driver (one for each partition or bucket) as a table; broadcast up to MOST_SMALL of them, joined like any other beyond that."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= MOST_SMALL else table


def unique_ids(df: DataFrame, key: str, text: str | None = None) -> tuple[DataFrame, bool]:
    """Adds rid, unique and ascending with key (nulls last; equal keys by the text's hash, equal rows in any order).

    Where key is unique and never null, rid is key itself and nothing moves (one small aggregate finds out).
    Else the rows are range-partitioned and numbered, with one offset for each partition.
    Returns the frame and whether rid is key."""
    odd = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(key).isNull())
    if not odd.limit(1).collect():
        return df.withColumn("rid", F.col(key).cast("long")), True
    order = [F.col(key).asc_nulls_last()] + ([F.xxhash64(text), F.coalesce(F.length(text), F.lit(0))] if text else [])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mixed = [*order, (F.xxhash64(F.monotonically_increasing_id()) % 1009).alias("spread")]  # a hot key is spread over ranges
    dealt = df.repartitionByRange(n, *mixed).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("at", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ids")
    before, total = [], 0
    for part, rows in sorted((r["at"], r["n"]) for r in dealt.groupBy("at").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each partition
        before.append((part, total))
        total += rows
    base = small_table(df.sparkSession, before, "at int, base long")
    return dealt.join(base, "at").withColumn("rid", F.col("base") + F.col("nth")).drop("at", "nth", "base"), False


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (id, root): root is the smallest id that id reaches; only ids with a smaller root are returned.

    Large-star and small-star steps by turns.  Minima are combined before the shuffle and joined back, so a
    node with very many links is one row on one side of a join that Spark can split.  Each round is a checkpoint."""
    shared_folder(edges.sparkSession)
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = small.select("e.u", "e.v").filter("u <> v").distinct().checkpoint()
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = tuple(mark)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
