"""Sinks: JSON Lines, named splits, checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.score import report_text


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder for each split, written in one pass."""
    rows.write.mode("overwrite").partitionBy(split).option("ignoreNullFields", "false").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of whole files, of any size: a file's lines are brought together in order and run through one digest, a batch at a time, so no file is held in memory.

    Lines end with a line feed alone, and bytes are taken as they are; the file's size tells whether its last line has an end.  Empty files have a digest too.  A line must fit in a row."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("line"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, left = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["path", "sha256"])

        for batch in batches:
            for path, size, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                if path != now:
                    if now is not None:
                        yield done()
                    now, digest, left = path, hashlib.sha256(), size
                raw = line.as_buffer()
                digest.update(raw)
                left -= raw.size
                if left > 0:  # what is left begins with the line's end
                    digest.update(b"\n")
                    left -= 1
        if now is not None:
            yield done()

    found = where.repartition(n, "path").sortWithinPartitions("path", "start", "nth").mapInArrow(run, "path string, sha256 string")
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:///")  # noqa: E731  # two ways to write one place
    files = spark.createDataFrame([(f,) for f in lines.inputFiles()], "path string")  # empty files have no lines; a row for each file
    return files.select(same("path").alias("path")).join(found.select(same("path").alias("path"), "sha256"), "path", "left").select("path", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports, a few rows, as JSON Lines in path/json and as text in path/text."""
    write_json_lines(reports.coalesce(1), f"{path}/json")
    report_text(reports).select("text").coalesce(1).write.mode("overwrite").text(f"{path}/text", lineSep="\n\n")
