"""Indexed search against a scan."""

import random
import re

import pytest

from tariffgrid.operators import catalog_query as C
from tariffgrid.operators import search_index as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    words = ["GPT", "Claude", "Ünï", "通义", "max", "pro", "mini", "a", "x-1", "%_", "[b]"]
    made = [(k, None if k % 11 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))) + (" needle" if k == 777 else ""), rng.choice(["OpenAI", "Qwen", None, ""])) for k in range(2000)]
    return spark.createDataFrame(made, "id int, model string, provider_name string").cache()


@pytest.fixture(scope="module")
def index(rows, tmp_path_factory):
    S.BLOCK_ROWS, kept = 100, S.BLOCK_ROWS
    yield S.search_index(rows, ("model", "provider_name"), str(tmp_path_factory.mktemp("index")))
    S.BLOCK_ROWS = kept


@pytest.mark.parametrize("text", ["", "  ", "g", "gp", "GPT", "claude max", "ünï", "通", "通义 pro", "openai", "needle", "nowhere", "%_", "[b]", "t c", "义 ", "aiq", "max pro mini"])
def test_same_rows_as_a_scan(rows, index, text):
    assert sorted(r["id"] for r in index.search(text).collect()) == sorted(r["id"] for r in rows.where(C.contains(text, "model", "provider_name")).collect())


def test_a_search_reads_the_blocks_that_can_hold_the_text(spark, index):
    def blocks_of(text):
        return {r[0] for r in index.rows.join(index.search(text).select("id"), "id").select(S._BLOCK).distinct().collect()}

    found = index.search("needle")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search("dynamicpruning|SubqueryBroadcast|DynamicPruning", plan, re.I) and len(blocks_of("needle")) == 1
    read = index.postings.where("gram = 'nee'").count()
    assert read == 1 < index.rows.select(S._BLOCK).distinct().count() == 20


def test_an_index_of_no_rows(rows, tmp_path):
    none = S.search_index(rows.limit(0), ("model",), str(tmp_path))
    assert none.search("a").collect() == [] and none.search("").collect() == []
