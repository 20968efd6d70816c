"""What the corpus operators share: words, durable cuts of lineage, Python tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch: bounds what a Python worker holds at once.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

_ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the Python stages rely on.

    Arrow batches are bounded by rows and bytes, unless the user has set these bounds, and
    Python workers can import the package from where the driver did. Both stay set in the
    session, as its plans are only run after the operators return.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, ARROW_BYTES),
    ):
        now = spark.conf.get(key, None)
        if now is None or now == default or (default is None and now.isdigit() and int(now) >= 1 << 31):
            spark.conf.set(key, str(value))
    env = spark.sparkContext.environment
    if _ROOT not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, *paths) if p)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, one of our own is made if driver and executors are one process; on
    a cluster that would be a folder of one machine, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tariffgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def durable(df: DataFrame, rows_a_part: int = 50_000) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    A table of few rows comes back in few partitions, so that the shuffles after it don't
    write a file for each of many nearly empty ones.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint()
    return kept.coalesce(max(1, -(-kept.count() // rows_a_part)))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; later scans read single columns of it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of stored() tables that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(value: Column) -> Column:
    """A hash of the value as a double in [0, 1): below any share, however small, lies that share of the values."""
    return F.xxhash64(value) / float(1 << 64) + 0.5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
