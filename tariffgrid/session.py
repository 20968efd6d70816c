"""Session settings for the batch jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tariffgrid", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; master and memory come from spark-submit or settings."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def new_table_path(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, which spark.checkpoint.dir names.

    Where it is unset, one is made if all is one process; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tariffgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
