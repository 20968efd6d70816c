"""Rows picked by their place among others: the newest, the nearest before, the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The row of each key (of the whole table without keys) that is last in the order; one aggregation, pre-aggregated by task."""
    last = rows.groupBy(*(by or [])).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("last row"))
    return last.where(F.col("last row").isNotNull()).select("`last row`.*")


def with_nearest(rows: DataFrame, value: Column, name: str, group: str = "source_id", pos: tuple[str, ...] = ("pos",)) -> DataFrame:
    """rows with the last non-null value at or before each place of its group."""
    before = W.partitionBy(group).orderBy(*pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(before))


def with_width(rows: DataFrame, at: Column, most: int, name: str, group: str, order: tuple[str, ...], end: Column | None = None) -> DataFrame:
    """rows with how far it is from each place to the next of its group, or else to the end, `most` at most."""
    after = F.lead(at).over(W.partitionBy(group).orderBy(*order))
    stop = after if end is None else F.coalesce(after, end)
    return rows.withColumn(name, F.least(F.coalesce(stop - at, F.lit(most)), F.lit(most)))


def with_fallback(rows: DataFrame, key: str, value: str, at: str, good: Column) -> DataFrame:
    """(key, value, is_stale): of each key the newest good value, or else the newest of all, marked stale."""
    seen = rows.groupBy(key).agg(F.max_by(F.when(good, F.col(value)), F.when(good, F.col(at))).alias("fresh"), F.max_by(value, at).alias("old"), F.bool_or(good).alias("any good"))
    return seen.select(key, F.when(F.col("any good"), F.col("fresh")).otherwise(F.col("old")).alias(value), (~F.col("any good")).alias("is_stale"))


def among(rows: DataFrame, ids: DataFrame, column: str, of: str | None = None) -> DataFrame:
    """The rows whose column is among the ids; how they are joined is left to their sizes."""
    return rows.join(ids.select(F.col(of or column).alias(column)).distinct(), column, "left_semi").select(rows.columns)


def not_among(rows: DataFrame, ids: DataFrame, column: str, of: str | None = None) -> DataFrame:
    return rows.join(ids.select(F.col(of or column).alias(column)).distinct(), column, "left_anti").select(rows.columns)


def known_only(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a table of known ones, with its columns."""
    return rows.join(known, key)
