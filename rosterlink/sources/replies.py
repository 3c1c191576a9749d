"""A Python data source for a registry's service: one reply for each key, fetched or replayed from captured ones.

    spark.dataSource.register(Replies)
    spark.read.format("replies").option("folder", captures).load()
    spark.read.format("replies").option("template", "https://.../{cik:010d}").option("agent", "me").option("first", 1).option("last", 500).load()

Replayed: a folder of captures by range of keys (see capture), a partition for each range; with first and last only the ranges that hold such keys are read.  The folder must be one that Python can open on every
executor.  Fetched: keys from first to last, in `parts` partitions, each of which waits `pause` seconds times the number of partitions after each reply, so all together keep to the rate; keys without a reply are skipped."""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .registry import fetched

RANGE = 1000


def capture(replies: DataFrame, folder: str, size: int = RANGE) -> None:
    """(cik, reply) as JSON Lines, a folder for each range of `size` keys; rows without a key or a reply are left out."""
    rows = replies.filter("cik is not null and reply is not null").select("cik", "reply", F.floor(F.col("cik") / size).alias("range"))
    rows.repartition("range").write.mode("overwrite").partitionBy("range").json(folder)
    rows.sparkSession.createDataFrame([(size,)], "size long").coalesce(1).write.mode("overwrite").json(f"{folder}/_size")


class Keys(InputPartition):
    def __init__(self, first: int, last: int, files: tuple[str, ...] = ()) -> None:
        self.first, self.last, self.files = first, last, files


class Replies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replies"

    def schema(self) -> str:
        return "cik bigint, reply string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RepliesReader(self.options)


class RepliesReader(DataSourceReader):
    get: Callable[[str, str], str] | None = None

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.template, self.agent = options.get("folder", "").removeprefix("file://"), options.get("template"), options.get("agent", "")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))
        self.parts, self.pause = int(options.get("parts", 1)), float(options.get("pause", 0.15))
        if bool(self.folder) == bool(self.template):
            raise ValueError("either a folder of captures or a template of addresses")
        if self.folder and "://" in self.folder:
            raise ValueError(f"{self.folder}: captures are opened by Python, so they must be in a folder that is mounted")
        if self.template and not ("first" in options and "last" in options):
            raise ValueError("fetching needs the first and the last key")

    def partitions(self) -> list[InputPartition]:
        if self.template:
            step = -(-max(0, self.last - self.first + 1) // self.parts)
            return [Keys(a, min(a + step - 1, self.last)) for a in range(self.first, self.last + 1, max(1, step))]
        with open(glob.glob(f"{glob.escape(self.folder)}/_size/*.json")[0]) as f:
            size = json.loads(f.readline())["size"]
        found = []
        for name in sorted(os.listdir(self.folder)):
            if name.startswith("range="):
                k = int(name.removeprefix("range="))
                if k * size <= self.last and (k + 1) * size > self.first:
                    found.append(Keys(self.first, self.last, tuple(sorted(glob.glob(f"{glob.escape(self.folder)}/{name}/*.json")))))
        return found

    def read(self, partition: Keys) -> Iterator[tuple]:
        for path in partition.files:
            with open(path, encoding="utf-8") as f:
                for line in f:
                    row = json.loads(line)
                    if partition.first <= row["cik"] <= partition.last:
                        yield row["cik"], row["reply"]
        if self.template:
            for cik in range(partition.first, partition.last + 1):
                try:
                    reply = fetched(self.template.format(cik=cik), self.agent, get=self.get)
                except Exception:
                    continue
                yield cik, reply
                time.sleep(self.pause * self.parts)
