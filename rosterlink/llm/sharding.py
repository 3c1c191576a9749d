"""Sharding: two-pass external shuffle under the law `rows`.

Pass one scatters the records into buckets that fit in memory, by a seeded hash of a key that is unique to each record, so that no id can fill a bucket;
pass two puts each bucket in random order (Fisher-Yates, seeded by the bucket) and writes it.  The counts of the buckets are added up, first inside runs of
buckets, then over the runs, which gives each bucket its place in the one long order; record number i goes to shard i mod n, slot i div n.  So
shard counts differ by one at most, and slots are without gaps.

Null texts weigh nothing and have checksum 0.  Records are ordered by id, then text (see unique_ids), before they are shuffled: records without an id or with a repeated one are
scattered like others.  Repeated rows and equal texts are records of their own and may go to different shards.  All columns of the input are kept; those called like
an output column are replaced.  An empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import bounded_batches, stored, unique_ids

BUCKET_BYTES = 4 << 20
PARTITION_BYTES = 256 << 20
RUN = 1024
OVERHEAD = 16


def places(counts: DataFrame) -> DataFrame:
    """(bucket, n) -> (bucket, base): how many records lie in the buckets before it."""
    runs = counts.withColumn("run", F.floor(F.col("bucket") / RUN))
    totals = runs.groupBy("run").agg(F.sum("n").alias("n"))  # a row for RUN buckets
    before = totals.select("run", (F.sum("n").over(W.orderBy("run")) - F.col("n")).alias("start"))
    inside = F.sum("n").over(W.partitionBy("run").orderBy("bucket")) - F.col("n")
    return runs.withColumn("inside", inside).join(before, "run").select("bucket", (F.col("start") + F.col("inside")).alias("base"))


def shuffle_to_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs -> the written records with (size, text_crc32, shard, slot), in the new order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("size", "text_crc32", "shard", "slot")
    size = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")) + OVERHEAD
    total = docs.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    fixed = size.alias("size"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0).cast("long")).alias("text_crc32")
    rows, _ = unique_ids(docs.select(F.struct(*docs.columns, *fixed).alias("record"), F.col(id_col).alias("key"), F.col(text_col).alias("text")), "key", "text")
    dealt = rows.select(F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.lit(buckets)).cast("int").alias("bucket"), "rid", "record")
    bases = places(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")))
    schema = StructType([*docs.schema.fields, StructField("size", LongType()), StructField("text_crc32", LongType()), StructField("shard", IntegerType()), StructField("slot", LongType())])

    def shuffled(records: pa.Table, base: pa.Table) -> pa.Table:
        rid = records["rid"].to_numpy()
        order = np.random.default_rng([seed, records["bucket"][0].as_py()]).permutation(np.argsort(rid))  # Fisher-Yates; arrival order is not repeatable
        record = records["record"].combine_chunks().take(pa.array(order))
        place = base["base"][0].as_py() + np.arange(len(order))
        return pa.Table.from_arrays([*record.flatten(), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)], names=schema.fieldNames())

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    met = dealt.repartition(n, "bucket").groupBy("bucket").cogroup(bases.toDF("own", "base").repartition(n, "own").groupBy("own"))  # records move once
    return stored(met.applyInArrow(shuffled, schema), "shards")
