"""Pages of a registry fetched by Spark's tasks, and their landing by run.

The pages are a batch data source with a partition for each page: a page is fetched where
its task runs, again if the task is lost, and a page that can't be had is a row that says why.
What was fetched is written before anything reads it, so that no later job fetches again.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tariffgrid.sources.fetch import Fetched, Page, static_fetch
from tariffgrid.sources.landing import TIMEOUT_S

#: What is kept of each page of a run; body is what the server sent, null if it failed.
FETCHED = (
    "source_id string, url string, kind string, status string, body binary, http_status int, size bigint, etag string, last_modified string, error string, attempts int, fetched_at string"
)
ATTEMPTS, PAUSE_S = 3, 1.0


def named_function(name: str | None) -> Callable | None:
    """The function that `module:name` names, which every machine can import."""
    if not name:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def fetch_row(page: Page, fetch: Callable[[str, int], Fetched], browse: Callable | None, timeout: int, attempts: int, pause_s: float) -> tuple:
    """A FETCHED row of one page, after so many attempts at most."""
    error, made = "", 0
    while made < attempts:
        made += 1
        try:
            got = browse(page.url, timeout, page.selector, page.settle_ms) if browse and page.kind == "browser" else fetch(page.url, timeout)
        except Exception as failure:  # noqa: BLE001  told in the row; other pages go on
            error = f"{type(failure).__name__}: {failure}"[:500]
            if made < attempts:
                time.sleep(pause_s * made)
            continue
        headers = {k.lower(): v for k, v in got.headers.items()}
        told = ("landed", got.body, got.status, len(got.body), headers.get("etag"), headers.get("last-modified"), None)
        break
    else:
        told = ("failed", None, None, None, None, None, error)
    return (page.source_id, page.url, page.kind, *told, made, datetime.now(timezone.utc).isoformat(timespec="seconds"))


class RegistryPages(DataSource):
    """Format `registry_pages`: options pages (a JSON array of the fields of Page), timeout, attempts, pause, fetch and browse (`module:function`)."""

    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return RegistryReader(dict(self.options))


class RegistryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = [Page(**p) for p in json.loads(options.get("pages", "[]"))]
        self.timeout = int(options.get("timeout", TIMEOUT_S))
        self.attempts, self.pause_s = int(options.get("attempts", ATTEMPTS)), float(options.get("pause", PAUSE_S))
        self.fetch, self.browse = options.get("fetch"), options.get("browse")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(len(self.pages))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.pages:  # without pages there is still one empty partition
            yield fetch_row(self.pages[partition.value], named_function(self.fetch) or static_fetch, named_function(self.browse), self.timeout, self.attempts, self.pause_s)


def fetched_pages(spark: SparkSession, pages: Iterable[Page], **options) -> DataFrame:
    """FETCHED rows, one a page. They are fetched whenever the rows are read: land them first."""
    spark.dataSource.register(RegistryPages)
    reader = spark.read.format(RegistryPages.name()).option("pages", json.dumps([asdict(p) for p in pages]))
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load()


def land_pages(rows: DataFrame, root: str, run_id: str) -> DataFrame:
    """Write FETCHED rows as the run's partition under root, compressed, and give them back as written.

    A run that lands again replaces its own rows and no others'. Small partitions are merged
    after the fetches, so that a run is a few files.
    """
    of = rows.hint("rebalance").withColumn("run_id", F.lit(run_id))
    of.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("run_id").parquet(root)
    return landed_pages(rows.sparkSession, root, run_id)


def landed_pages(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """FETCHED rows with their run_id, of one run or of all."""
    rows = spark.read.schema(f"{FETCHED}, run_id string").parquet(root)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def page_bodies(landed: DataFrame) -> DataFrame:
    """(source_id, body) of the landed pages, as text; bytes that are no UTF-8 become U+FFFD."""
    return landed.where("status = 'landed'").select("source_id", F.make_valid_utf8(F.col("body").cast("string")).alias("body"))


def page_versions(landed: DataFrame) -> DataFrame:
    """What the history keeps of each landed page: checksum and size of what was sent, and its version."""
    kept = landed.where("status = 'landed'")
    return kept.select("run_id", "source_id", "fetched_at", F.sha2("body", 256).alias("checksum"), F.octet_length("body").cast("bigint").alias("size"), "etag", "last_modified")
