"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows it is given; docs has the columns of documents, as all stages but the last return them.

In every stage null texts count as empty, an empty table gives an empty result, texts are read whole however long they are, and other columns of docs go through unchanged, whatever
their names (the last stage drops them).  Ids may be null or repeated: each row is a document of its own; what that means for ties is said at each stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlink.llm import minhash, packing, quality, suffix_dedup
from rosterlink.llm.common import stored
from rosterlink.llm.queries import read, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those with a score below the threshold.  Equal texts have equal scores, so repeated rows stay or go together; empty texts are judged like others."""
    model = quality.fit(docs, quality.learnable(read(spark, sf_dir, "labels")))
    scored = quality.score(docs.select("text", F.struct(*docs.columns).alias("row")), model)
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id: five words, a similarity of 0.8.

    Of equal ids, or without one, the first by the hash of its text, then any of equal rows.  Texts without words are linked with nothing and stay."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80, band_rows=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes stays once in the corpus, where it starts first by id, then by place; characters stay whole, n_chars is counted anew.

    Rows with equal ids, or without one, are ordered by the hash of their text, then in any order.  Null texts stay null; documents that lose all their text stay, empty."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = suffix_dedup.remove_repeats(docs, keep=others)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens as pieces (see packing.pack); ids are little-endian unsigned 32-bit numbers.

    An empty text is its end id alone; rows with equal ids, or without one, are packed like others, each as a document of its own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


STAGES = [("quality", good_quality), ("near_duplicates", without_near_duplicates), ("repeats", without_repeats), ("packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
