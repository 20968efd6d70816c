"""Deep pages against a sort of everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tariffgrid.operators import catalog_query as C
from tariffgrid.operators.paging import RANGE, SortKey, next_page, page_index, token


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    made = [(f"{k:05d}", rng.choice([None, None, None, 1.0, 2.5, float(k % 17)]), rng.choice(["b", "Ä", "a", "z", None])) for k in range(3000)]  # a third and more without a price
    return spark.createDataFrame(made, "id string, compare_input double, model string").repartition(4).cache()


@pytest.mark.parametrize("option", ["inputPrice:asc", "inputPrice:desc", "model:asc", "model:desc"])
def test_pages_by_number_and_by_token(rows, tmp_path, option):
    keys = C.sort_keys(option)
    every = [r["id"] for r in rows.orderBy(*C.sort_columns(option)).collect()]
    index = page_index(rows, keys, str(tmp_path), 16)
    assert index.total == 3000 and len(index.ranges) > 8 and max(n for _, _, n in index.ranges) < 900  # nulls are dealt out too
    for number in (1, 2, 7, 31, 60, 61, -3):
        at = min(max(1, number), 60)
        assert [r["id"] for r in index.page(number, 50).collect()] == every[(at - 1) * 50 : at * 50], number
    name = "compare_input" if option.startswith("input") else "model"
    got, last = [], None
    while page := next_page(rows, keys, last, 700).collect():
        got += [r["id"] for r in page]
        last = token(page[-1], [name, "id"])
    assert got == every


def test_a_page_reads_and_sorts_its_ranges_only(spark, rows, tmp_path):
    index = page_index(rows, C.sort_keys("inputPrice:asc"), str(tmp_path), 16)
    page = index.page(40, 50)
    plan = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    (filters,) = re.findall(r"PartitionFilters: \[(.*)\]", plan)
    read = re.findall(rf"{RANGE}#\d+ (?:=|IN) \(?([\d,]+)", filters)
    assert len(read) == 1 and len(read[0].split(",")) <= 2 < len(index.ranges)


def test_no_rows_and_other_keys(spark, rows, tmp_path):
    none = page_index(rows.limit(0), C.sort_keys("inputPrice:asc"), str(tmp_path / "a"), 4)
    assert none.total == 0 and none.page(3).collect() == []
    dated = spark.createDataFrame([("a", None), ("b", 3), ("c", 1)], "id string, n int")
    keys = (SortKey(F.col("n"), True), SortKey(F.col("id")))
    assert [r["id"] for r in next_page(dated, keys, "[3, \"b\"]").collect()] == ["c", "a"] and next_page(dated, keys, '[null, "a"]').collect() == []


def test_a_query_is_indexed_with_its_filter(rows, tmp_path):
    plain = rows.select("*", F.lit("p").alias("provider_id"), F.lit("P").alias("provider_name"), F.lit("per_token").alias("billing_type"), F.array(F.lit("text")).alias("modalities"))
    asked = C.CatalogQuery(search="z", sort="inputPrice:asc", page=2, page_size=40)
    assert [r["id"] for r in asked.indexed(plain, str(tmp_path), 8).page(2, 40).collect()] == [r["id"] for r in asked.run(plain).collect()]
