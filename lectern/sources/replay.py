"""A Python data source that replays recorded API pages.

`spark.read.format("recorded_pages")` with either
  path   a folder of files page-<n>.json: one partition for each page number (page-numbered APIs), or
  path and chain=true: pages linked by their cursors, read one after another in one partition (cursor APIs).
Each row is (page int, body string); bodies are parsed by the readers' from_json schemas.  A page that is missing or broken
gives a row in errors rather than a failed scan when option errors=keep.  The data source opens the files itself, so its path
must be one that every executor sees as a local folder; recorded_pages() reads the same files from any store with Spark's reader.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Pages(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.chain, self.keep = options["path"], options.get("chain") == "true", options.get("errors") == "keep"

    def partitions(self) -> list[InputPartition]:
        if self.chain:
            return [InputPartition(-1)]
        names = [f for f in os.listdir(self.path) if f.startswith("page-") and f.endswith(".json")]
        return [InputPartition(n) for n in sorted(int(f[5:-5]) for f in names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value >= 0:
            yield self._page(partition.value)
            return
        number = 1
        while True:
            page, body, error = self._page(number)
            yield page, body, error
            info = {} if error else _page_info(json.loads(body))
            if not info.get("hasNextPage"):
                return
            number += 1

    def _page(self, number: int) -> tuple:
        try:
            with open(f"{self.path}/page-{number}.json", encoding="utf-8") as f:
                body = f.read()
            json.loads(body)
            return number, body, None
        except (OSError, ValueError) as e:
            if not self.keep:
                raise
            return number, None, str(e)


def _page_info(node: object) -> dict:
    """The first pageInfo inside a page."""
    if isinstance(node, dict):
        if "pageInfo" in node:
            return node["pageInfo"]
        node = list(node.values())
    if isinstance(node, list):
        for x in node:
            if found := _page_info(x):
                return found
    return {}


class RecordedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "page int, body string, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Pages(dict(self.options))


def recorded_pages(spark: SparkSession, path: str, chain: bool = False) -> DataFrame:
    """page, body of the files page-<n>.json below path, read by Spark; with chain, up to the first page that has no next one."""
    files = spark.read.option("wholetext", True).text(f"{path}/page-*.json").select("value", F.col("_metadata.file_name").alias("name"))
    pages = files.select(F.regexp_extract("name", r"page-(\d+)\.json", 1).cast("int").alias("page"), F.col("value").alias("body"))
    if not chain:
        return pages
    last = pages.where(~F.col("body").rlike(r'"hasNextPage"\s*:\s*true')).agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("last"))
    return pages.crossJoin(F.broadcast(last)).where("page <= last").drop("last")  # one row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedPages)
