"""Newly landed pages as a stream, and their snapshots appended to the history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tariffgrid.plans.history import History
from tariffgrid.sources.landing import file_pages, snapshot_rows
from tariffgrid.sources.registry import FETCHED, page_versions


def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, body, landed_at) of every page file that lands in the folder or one below it, compressed or not.

    Names, kinds of files and texts are those of the batch read; the landing's own report is no page.
    """
    return file_pages(spark.readStream, folder).select("source_id", "body", "landed_at")


def stream_landed(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the landed registry pages, with run_id, as runs add their partitions under root."""
    return spark.readStream.schema(f"{FETCHED}, run_id string").parquet(root)


def append_snapshots(stream: DataFrame, history: History, run_id: str, checkpoint: str):
    """One pass over what has landed since the last one; the checkpoint remembers which files are done."""

    def add(batch: DataFrame, _: int) -> None:
        history.append("source_snapshots", snapshot_rows(batch, run_id, datetime.now(timezone.utc).isoformat(timespec="seconds")))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_landed(stream: DataFrame, history: History, checkpoint: str):
    """One pass over the runs that landed since the last one: their versions go to the history.

    The rows of a run replace those it had, so a batch that is repeated after a loss adds nothing twice.
    A run lands in one write, and its files come in one batch.
    """

    def put(batch: DataFrame, _: int) -> None:
        history.replace("source_snapshots", page_versions(batch))

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
