"""Landed inputs: JSON documents and pages on shared storage, one row a file."""

from __future__ import annotations

import gzip
import json
import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.schema import PLAN_FIELDS, as_plans, ddl

#: Fetch settings for whoever lands the pages: seconds, and milliseconds for a page to settle without a selector.
TIMEOUT_S, SETTLE_MS = 45, 1500
#: Kinds of landed files, and the file in which landing tells of each source.
SUFFIXES, REPORT = ("html", "htm", "md", "json", "txt"), "landing-report.json"


@dataclass(frozen=True)
class Config:
    """Settings of a run, from the environment or given."""

    data_dir: str = "data"
    public_path: str = "data/public/catalog.json"
    directory_url: str = ""
    fx_url: str = ""
    timeout_s: int = TIMEOUT_S
    minimum_offers: int = 250
    minimum_plans: int = 30
    maximum_drop: float = 0.20

    @classmethod
    def from_env(cls, prefix: str = "TARIFFGRID_") -> Config:
        default = cls()
        return cls(**{f: type(getattr(default, f))(os.environ[key]) for f in cls.__dataclass_fields__ if (key := prefix + f.upper()) in os.environ})


def file_pages(reader, folder: str) -> DataFrame:
    """(source_id, body, landed_at, run_id) of page files, from a batch or a stream reader: <source_id>.html, .md, .json or .txt, or .gz of them.

    run_id is what a folder run_id=... above the file says, else null.
    """
    files = reader.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(SUFFIXES)},gz}}").load(folder)
    name = F.regexp_replace("_metadata.file_name", rf"(\.({'|'.join(SUFFIXES)}))?(\.gz)?$", "")
    run = F.nullif(F.regexp_extract("_metadata.file_path", r"/run_id=([^/]+)/", 1), F.lit(""))
    rows = files.select(name.alias("source_id"), F.make_valid_utf8("value").alias("body"), F.col("_metadata.file_modification_time").alias("landed_at"), run.alias("run_id"))
    return rows.where(F.col("source_id") != REPORT.partition(".")[0])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source_id, body) of every page file of a folder."""
    return file_pages(spark.read, folder).select("source_id", "body")


def snapshot_rows(pages: DataFrame, run_id: str, fetched_at: str, folder: str | None = None) -> DataFrame:
    """What the history keeps of each landed page: checksum and size with run and time, and what its server said of its version."""
    raw = F.encode("body", "UTF-8")
    rows = pages.select(F.lit(run_id).alias("run_id"), "source_id", F.lit(fetched_at).alias("fetched_at"), F.sha2(raw, 256).alias("checksum"), F.length(raw).cast("bigint").alias("size"))
    told = [(r["source_id"], r.get("etag"), r.get("last_modified")) for r in read_report(folder)]
    return rows.join(pages.sparkSession.createDataFrame(told, "source_id string, etag string, last_modified string"), "source_id", "left").select(*rows.columns, "etag", "last_modified")


def read_report(folder: str | None) -> list[dict]:
    """What landing told of each source of a folder; nothing if it was filled by other means."""
    path = Path(folder) / REPORT if folder else None
    return json.loads(path.read_text(encoding="utf-8")) if path and path.is_file() else []


def land(folder: str, source_id: str, raw: bytes, suffix: str = "html") -> str:
    """Write one fetched body, compressed, and return where."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder) / f"{source_id}.{suffix}.gz"
    path.write_bytes(gzip.compress(raw))
    return str(path)


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The text of the first path that can be read; an error that names them all if none can."""
    failures = []
    for path in paths:
        try:
            found = spark.read.text(path, wholetext=True)
            if found.head(1):
                return found
        except Exception as error:  # noqa: BLE001  a missing or unreadable path leads to the next
            failures.append(f"{path}: {type(error).__name__}")
    raise FileNotFoundError("; ".join(failures) or "no paths")


def published_plans(spark: SparkSession, path: str) -> DataFrame:
    """Plans of a published catalog file, unknown fields dropped and absent ones defaulted; none if it can't be read."""
    empty = spark.createDataFrame([], ddl(PLAN_FIELDS))
    try:
        text = spark.read.text(path, wholetext=True)
        text.head(1)
    except Exception:  # noqa: BLE001  no artifact yet
        return empty
    fields = ddl(PLAN_FIELDS | {"raw": "variant"})
    doc = text.select(F.from_json("value", f"plans array<struct<{fields}>>").alias("d"))
    rows = doc.select(F.explode("d.plans").alias("p")).select("p.*").withColumn("raw", F.to_json("raw"))
    return as_plans(rows.where("plan_id is not null and provider_id is not null and product_name is not null and source_url is not null"))


def selection(text: str | None, most: int = 4) -> list[str]:
    """Stored selection: a JSON array of ids, of which texts are kept, so many at most; anything else is empty."""
    try:
        found = json.loads(text or "[]")
    except ValueError:
        return []
    return [x for x in found if isinstance(x, str)][:most] if isinstance(found, list) else []
