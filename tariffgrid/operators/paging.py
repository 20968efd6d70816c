"""Deep pages of ordered rows: an index by ranges, and pages that start after a given row.

A limit with an offset sorts everything up to its end. Here rows are dealt once into ranges
of the order, each counted; a page then reads and sorts only the ranges it lies in. The next
page needs no number at all: it is the first rows after the last row's keys.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Column of the ranges in an index.
RANGE = "page range"


@dataclass(frozen=True)
class SortKey:
    """A key of an order, nulls last either way; with a collation its texts are compared by that."""

    value: Column
    descending: bool = False
    collation: str | None = None

    @property
    def compared(self) -> Column:
        return F.collate(self.value, self.collation) if self.collation else self.value

    def ordered(self) -> Column:
        return self.compared.desc_nulls_last() if self.descending else self.compared.asc_nulls_last()

    def after(self, last: Column) -> Column:
        """Whether the row's key stands after `last`, false if either can't tell."""
        last = F.collate(last, self.collation) if self.collation else last
        beyond = self.compared < last if self.descending else self.compared > last
        return last.isNotNull() & (self.value.isNull() | F.coalesce(beyond, F.lit(False)))

    def level(self, last: Column) -> Column:
        return self.compared.eqNullSafe(F.collate(last, self.collation) if self.collation else last)


@dataclass(frozen=True)
class PageIndex:
    """Ranges of an order with the rows before each. Made once for many pages; its files are the caller's to delete."""

    rows: DataFrame
    keys: tuple[SortKey, ...]
    #: (range, rows before it, rows in it), in order; as many as there are ranges.
    ranges: tuple[tuple[int, int, int], ...]

    @property
    def total(self) -> int:
        return sum(n for _, _, n in self.ranges)

    def page(self, number: int, size: int = 50) -> DataFrame:
        """One page, by number from 1; a number out of range means the nearest page. Only the page's ranges are read and sorted."""
        number = min(max(1, number), max(1, -(-self.total // size)))
        low, high = (number - 1) * size, number * size
        touched = [(k, before) for k, before, n in self.ranges if before < high and low < before + n]
        held = self.rows.where(F.col(RANGE).isin([k for k, _ in touched])).drop(RANGE)
        ordered = held.orderBy(*(k.ordered() for k in self.keys))
        skip = low - touched[0][1] if touched else 0
        return (ordered.offset(skip) if skip else ordered).limit(size)


def page_index(rows: DataFrame, keys: tuple[SortKey, ...], path: str, ranges: int = 64) -> PageIndex:
    """Deal rows into so many ranges of the order, written under path.

    The keys should end in one that no two rows share: then no value, null or not, however
    frequent, keeps more rows together than a range should hold, and every page is
    determined. ranges: so many that one of them is sorted with ease.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(ranges, *(k.ordered() for k in keys)).withColumn(RANGE, F.spark_partition_id())
    dealt.write.mode("overwrite").partitionBy(RANGE).parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path)
    counts, before, found = sorted((r[RANGE], r["n"]) for r in written.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()), 0, []
    for k, n in counts:  # a number for each range
        found.append((k, before, n))
        before += n
    return PageIndex(written, tuple(keys), tuple(found))


def token(row, names: list[str]) -> str:
    """Where a page ended, as text: the values of its last row's keys (columns by name)."""
    return json.dumps([row[n] for n in names], ensure_ascii=False, default=str)


def after(keys: tuple[SortKey, ...], last: list) -> Column:
    """Rows that stand after these key values in the order: greater in one key and level in those before it."""
    values = [F.lit(v) for v in last]
    ways = [reduce(lambda a, b: a & b, [k.level(v) for k, v in zip(keys[:i], values)], keys[i].after(values[i])) for i in range(len(keys))]
    return reduce(lambda a, b: a | b, ways, F.lit(False))


def next_page(rows: DataFrame, keys: tuple[SortKey, ...], last: str | None, size: int = 50) -> DataFrame:
    """The rows after a token, the first page without one: a filter and a top-k, whatever the depth."""
    kept = rows if last is None else rows.where(after(keys, json.loads(last)))
    return kept.orderBy(*(k.ordered() for k in keys)).limit(size)
