"""Substring search by an inverted index of character n-grams, with the same rows as a scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram; a shorter text is looked up by a gram of its own length.
GRAM = 3
#: Rarest grams of a search whose postings are read, and ranges that the postings are dealt into.
GRAMS_READ, BUCKETS = 3, 64
#: Rows of one block of the stored rows, the unit that a search reads.
BLOCK_ROWS = 10_000
_BLOCK, _BUCKET = "search block", "search bucket"


def _folded(columns: tuple[str, ...]) -> Column:
    """The searched columns in lower case, parted by a character that no search text holds."""
    return F.concat_ws("\u0000", *(F.lower(c) for c in columns))


def _grams(text: Column) -> Column:
    """The distinct grams of 1 to GRAM characters."""
    of = lambda k: F.when(F.length(text) >= k, F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substr(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(k) for k in range(1, GRAM + 1))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class SearchIndex:
    """Rows by block, the blocks of each gram, and how many those are. Made once for many searches; its files are the caller's to delete."""

    rows: DataFrame
    postings: DataFrame
    columns: tuple[str, ...]

    def search(self, text: str) -> DataFrame:
        """The rows in one of whose columns the text stands, case-blind; all rows for an empty text.

        Blocks that hold the text's rarest grams are read, and each of their rows is looked at. The grams of a
        text are as many as its characters, so that their counts are looked up at once.
        """
        wanted = text.strip().lower()
        if not wanted:
            return self.rows.drop(_BLOCK)
        grams = sorted({wanted[i : i + GRAM] for i in range(max(1, len(wanted) - GRAM + 1))})
        table = self.postings.where(F.col("gram").isin(grams) & F.col(_BUCKET).isin([r[0] for r in self.rows.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]))
        counts = {r["gram"]: r["n"] for r in table.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}
        rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:GRAMS_READ]
        blocks = table.where(F.col("gram").isin(rarest)).groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select(_BLOCK)
        found = F.lit(False)
        for c in self.columns:
            found = found | F.coalesce(F.lower(c).contains(wanted), F.lit(False))
        return self.rows.join(blocks, _BLOCK, "left_semi").where(found).drop(_BLOCK)


def search_index(rows: DataFrame, columns: tuple[str, ...], path: str, order: tuple[str, ...] = (), n: int | None = None) -> SearchIndex:
    """Index rows under path for substring search in the columns.

    Rows are dealt into blocks by ranges of `order` (the searched columns by default): like texts
    share blocks, so that a text stands in few of them. A gram has a row for each block it is
    in, never one for each row, and the most frequent gram at most as many rows as there are blocks.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-(rows.count() if n is None else n) // BLOCK_ROWS))
    dealt = rows.repartitionByRange(blocks, *(order or columns)).withColumn(_BLOCK, F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy(_BLOCK).parquet(f"{path}/rows")
    stored = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    grams = stored.select(_BLOCK, F.explode(_grams(_folded(columns))).alias("gram")).distinct().withColumn(_BUCKET, _bucket(F.col("gram")))
    grams.repartition(_BUCKET).sortWithinPartitions("gram").write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/grams")
    return SearchIndex(stored, spark.read.schema(grams.schema).parquet(f"{path}/grams"), tuple(columns))
