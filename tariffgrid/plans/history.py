"""History of runs, snapshots and releases as Parquet tables: a log of run events, and tables whose keys are written whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tariffgrid.operators.quality import Gate, drop_ratio
from tariffgrid.operators.selection import among, newest
from tariffgrid.schema import OFFER_FIELDS, PLAN_FIELDS, as_offers, as_plans, ddl

#: Column types of the tables; later columns may be added, older files then read as null.
TABLES = {
    "run_events": "run_id string, status string, at string, detail string",
    "source_snapshots": "run_id string, source_id string, fetched_at string, checksum string, size bigint, etag string, last_modified string",
    "fx_snapshots": "fx_id string, run_id string, published_date string, rates string",
    "catalog_snapshots": "snapshot_id string, run_id string, created_at string, offer_count bigint, plan_count bigint, provider_count bigint",
    "releases": "release_id string, snapshot_id string, published_at string",
    "model_offers": ddl(OFFER_FIELDS) + ", snapshot_id string",
    "plans": ddl(PLAN_FIELDS) + ", content_checksum string, snapshot_id string",
}
#: Tables whose rows belong to a key, by which they are partitioned: what is written for a key replaces what it had.
KEYS = {"source_snapshots": "run_id", "fx_snapshots": "fx_id", "catalog_snapshots": "snapshot_id", "releases": "release_id", "model_offers": "snapshot_id", "plans": "snapshot_id"}


@dataclass(frozen=True)
class History:
    """The tables under one folder; a single writer at a time writes them."""

    spark: SparkSession
    root: str

    def read(self, table: str) -> DataFrame:
        """The whole table, empty if nothing has been written yet."""
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        path = f"{self.root}/{table}"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path).select(schema.names)

    def append(self, table: str, rows: DataFrame) -> None:
        writer = rows.write.mode("append")
        (writer.partitionBy(KEYS[table]) if table in KEYS else writer).parquet(f"{self.root}/{table}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write the rows in place of all that their keys had; other keys stay. Doing it again changes nothing.

        Only the partitions of the keys at hand are exchanged, when the job commits. Keys
        without rows are not touched: there is nothing to tell them by.
        """
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEYS[table]).parquet(f"{self.root}/{table}")

    def forget(self, table: str, key: str) -> None:
        """Remove a key's rows."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}/{KEYS[table]}={key}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def add(self, table: str, *rows: tuple) -> None:
        """Append to a log, or replace by key."""
        made = self.spark.createDataFrame(list(rows), TABLES[table])
        self.replace(table, made) if table in KEYS else self.append(table, made)

    def save_snapshot(self, snapshot_id: str, run_id: str, created_at: str, offers: DataFrame, plans: DataFrame, gates: tuple[Gate, Gate] | None = None) -> tuple[DataFrame, DataFrame]:
        """Offers and plans as written; the header row last, and only a snapshot with a header counts.

        With gates, the jobs that write also measure: nothing is computed twice, and the
        offers' gate is judged before the plans are made. A snapshot that doesn't pass is removed.
        """
        of = lambda rows: rows.withColumn("snapshot_id", F.lit(snapshot_id))
        summed = as_plans(plans).withColumn("content_checksum", F.sha2(F.to_json(F.try_parse_json("raw")), 256))
        written = []
        try:
            for table, rows, gate in (("model_offers", as_offers(offers), gates and gates[0]), ("plans", summed, gates and gates[1])):
                self.replace(table, of(gate.watched(rows) if gate else rows))
                written.append(self.read(table).where(F.col("snapshot_id") == snapshot_id))
                if gate:
                    gate.judge(written[-1])
        except Exception:
            for table in ("model_offers", "plans"):
                self.forget(table, snapshot_id)
            raise
        counts = counted(*written).first()
        self.add("catalog_snapshots", (snapshot_id, run_id, created_at, counts["offer_count"], counts["plan_count"], counts["provider_count"]))
        return as_offers(written[0]), as_plans(written[1])

    def runs(self) -> DataFrame:
        """The latest event of each run."""
        return self.read("run_events").groupBy("run_id").agg(F.max_by(F.struct("status", "at", "detail"), F.struct("at", "status")).alias("e"), F.min("at").alias("started_at")).select("run_id", "started_at", "e.*")

    def releases(self) -> DataFrame:
        return with_release_status(self.read("releases"))

    def previous_counts(self) -> tuple[int, int] | None:
        """Offers and plans of the latest release, whatever its status."""
        found = latest_release(self.read("releases"), self.read("catalog_snapshots")).first()
        return (found["offer_count"], found["plan_count"]) if found else None

    def last_good_plans(self, source_id: str) -> DataFrame:
        """A source's plans in the latest release. Found by registry entry, as two entries may share a page."""
        latest = latest_release(self.read("releases"), self.read("catalog_snapshots")).select("snapshot_id")
        kept = among(self.read("plans"), latest, "snapshot_id")
        return as_plans(kept.where(F.col("source_id") == source_id))


def counted(offers: DataFrame, plans: DataFrame) -> DataFrame:
    """One row: offers, plans, distinct providers of both, distinct automatic sources of both."""
    parts = offers.select(F.lit(0).alias("is_plan"), "provider_id", F.col("source_id").alias("origin")).unionByName(plans.select(F.lit(1).alias("is_plan"), "provider_id", F.col("source_url").alias("origin")))
    return parts.agg(
        F.count_if(F.col("is_plan") == 0).alias("offer_count"), F.count_if(F.col("is_plan") == 1).alias("plan_count"), F.countDistinct("provider_id").alias("provider_count"),
        F.countDistinct("is_plan", "origin").alias("source_count"),
    )


def latest_release(releases: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The newest release with its snapshot's columns."""
    return newest(releases.join(snapshots, "snapshot_id"), ["published_at", "release_id"])


def with_release_status(releases: DataFrame) -> DataFrame:
    """published for the newest release, superseded for all others."""
    latest = releases.agg(F.max(F.struct("published_at", "release_id")).alias("m"))
    marked = releases.crossJoin(F.broadcast(latest))  # one row
    return marked.withColumn("status", F.when(F.struct("published_at", "release_id") == F.col("m"), "published").otherwise("superseded")).drop("m")


def drop_ratios(counts: DataFrame, at: str, n: str) -> DataFrame:
    """counts with the ratio that each lost against the one before; a table of one row a release."""
    before = F.lag(n).over(W.orderBy(at))
    return counts.withColumn("drop_ratio", drop_ratio(F.col(n), before))
