"""Registries: JSON Lines with fixed schemas, captured replies of the registry's service, and a stand-in over the part table."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from ..shared import stored

FORMER = "array<struct<name: string, `from`: string, `to`: string>>"
RAW = f"cik bigint, name string, entityType string, sic string, sicDescription string, tickers array<string>, exchanges array<string>, formerNames {FORMER}"
HOLDOUT = f"cik bigint, name string, ticker string, entityType string, formerNames {FORMER}"
INDEX = "name string, cik bigint, entity_type string, former_names array<string>"
CHAT = "messages array<struct<role: string, content: string>>, difficulty string, easy boolean"


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Blank lines are skipped; if strict, a blank line or one that is no object raises.  A missing path raises at once."""
    if not strict:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path)
    row = F.from_json("value", schema, {"mode": "FAILFAST"})
    blank = F.raise_error(F.lit(f"a blank line in {path}"))
    return lines.select(F.when(F.trim("value") == "", blank.cast(row_type(schema))).otherwise(row).alias("r")).select("r.*")


def row_type(schema: str) -> str:
    return "struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(schema)) + ">"


def names_of(former: F.Column) -> F.Column:
    """The names of former names, empty where there is none."""
    return F.coalesce(F.transform(former, lambda f: F.coalesce(f["name"], F.lit(""))), F.array().cast("array<string>"))


def registry_rows(raw: DataFrame) -> DataFrame:
    """(cik, name, entity_type, former_names) of named rows."""
    return raw.filter("name is not null and name <> ''").select("cik", "name", F.col("entityType").alias("entity_type"), names_of(F.col("formerNames")).alias("former_names"))


def with_order(*registries: DataFrame) -> DataFrame:
    """The union with ord: rows of earlier registries first, each in its own order of input.

    Rows read from files come file by file, by name, and inside a file in its own order: Spark packs files and parts of files into tasks by size, so each part is ranked by its file and its
    first byte.  To have files in another order, give each as a registry.  Rows that are not from files come as their partitions do."""
    out = None
    for k, df in enumerate(registries):
        df = (in_file_order(df) if from_files(df) else df.withColumn("ord", F.monotonically_increasing_id())).withColumn("ord", F.lit(k << 56) + F.col("ord"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def from_files(df: DataFrame) -> bool:
    try:
        return bool(df.select("_metadata.file_path", "_metadata.file_block_start").columns)
    except AnalysisException:
        return False


def in_file_order(df: DataFrame) -> DataFrame:
    """Rows of one scan with ord: a number for each part of a file, a row each, adds up what comes before it."""
    names = [c for c in df.columns if c != "ord"]
    rows = df.select(F.struct(*names).alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    rows = stored(rows, "rows")  # the numbers stay as they are
    parts = rows.groupBy("file", "start").agg(F.min("id").alias("first"), (F.max("id") - F.min("id") + 1).alias("n"))  # numbers of one part follow one another
    before = W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("file", "start", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("away"))
    return rows.join(parts, ["file", "start"]).select("row.*", (F.col("id") + F.col("away")).alias("ord"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """A registry's list, one object of objects in a file -> (cik, ticker, title)."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.map_values(F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>"))).alias("v")).select(F.col("v.cik_str").alias("cik"), "v.ticker", "v.title")


def enriched(list_rows: DataFrame, submissions: DataFrame) -> DataFrame:
    """The eight kept fields for each listed cik that a captured submission is there for."""
    kept = submissions.select("cik", "name", "entityType", "sic", "sicDescription", *(F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tickers", "exchanges")), F.coalesce("formerNames", F.array().cast(FORMER)).alias("formerNames"))
    return list_rows.select("cik").join(kept, "cik")


def fetched(url: str, agent: str, retries: int = 3, get: Callable[[str, str], str] | None = None, wait: Callable[[float], None] = time.sleep) -> str:
    """One reply; waits 1, 2, 4 seconds after 403 and 429 and 1, 2, 3 after other faults; other HTTP errors are raised at once."""

    def plain(address: str, who: str) -> str:
        with urllib.request.urlopen(urllib.request.Request(address, headers={"User-Agent": who}), timeout=30) as reply:
            return reply.read().decode()

    for k in range(retries):
        try:
            return (get or plain)(url, agent)
        except urllib.error.HTTPError as e:
            if e.code not in (403, 429):
                raise
            wait(2**k)
        except Exception:
            wait(1 + k)
    raise RuntimeError(f"no reply from {url} in {retries} tries")


def fetch_all(keys: DataFrame, template: str, agent: str, pause: float = 0.15, get: Callable[[str, str], str] | None = None) -> DataFrame:
    """(cik) -> (cik, reply) in one partition, `pause` seconds after each reply; keys without a reply are skipped."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for cik in part["cik"]:
                try:
                    rows.append((cik, fetched(template.format(cik=int(cik)), agent, get=get)))
                except Exception:
                    continue
                time.sleep(pause)
            yield pd.DataFrame(rows, columns=["cik", "reply"])

    return keys.select("cik").coalesce(1).mapInPandas(run, "cik long, reply string")


def spread(rows: DataFrame) -> DataFrame:
    """A table of fewer files than cores is dealt out to all of them: a registry's rows are small, what is made of each of them is not."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= n else rows.repartition(n)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry over the part table: cik, name, entity_type, former_names, ord."""
    key = F.col("p_partkey")
    endings = [", Inc.", " INC", " Corp.", " & Co.", ", LLC", " Ltd.", " Holdings", " plc"]
    ending = F.element_at(F.array(*map(F.lit, endings)), (key % 8 + 1).cast("int"))
    name = F.concat("p_name", F.lit(" "), F.lower("p_type"), F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit(" ")), F.lit(" "), F.col("p_size").cast("string"), ending)
    none = F.array().cast("array<string>")
    former = F.when(key % 3 == 0, none).when(key % 3 == 1, F.array(F.concat("p_name", F.lit(" "), F.lower("p_brand")))).otherwise(
        F.array(F.concat("p_name", F.lit(" co")), F.when(key % 7 == 0, F.upper(name)).otherwise("")))
    kind = F.when(key % 5 != 0, F.lower("p_type"))
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(key.alias("cik"), name.alias("name"), kind.alias("entity_type"), former.alias("former_names"), key.alias("ord"))
