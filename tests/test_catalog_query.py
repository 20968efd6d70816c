import pytest
from pyspark.sql import functions as F

from tariffgrid.functions.model_names import name_parts
from tariffgrid.operators import catalog_query as C
from tariffgrid.plans import fx
from tariffgrid.schema import as_offers, as_plans

KIND = "offer_id string, provider_id string, provider_name string, model_name string, currency string, input_per_1m double, output_per_1m double, cache_read_per_1m double, context_window long, modalities array<string>, release_date string, market string"
OFFERS = [
    ("o1", "openai", "OpenAI", "GPT-5", "USD", 1.0, 4.0, None, 400_000, ["text", "vision"], "2026-01-01", "global"),
    ("o2", "openai", "OpenAI", "GPT-5.5 Sol", "USD", 3.0, 9.0, 0.5, 1_000_000, ["text"], "2025-06-01", "global"),
    ("o3", "qwen", "阿里通义", "Qwen4 Max", "CNY", 6.0, 20.0, None, None, ["text"], "", "cn_mainland"),
    ("o4", "qwen", "阿里通义", "Qwen3 Max", "CNY", None, 8.0, None, 64_000, ["text"], "2026-02-01", None),
    ("o5", "zed", "Zed", "Odd", "XXX", 2.0, 2.0, None, 128_000, [], "not a date", "global"),
]
PLANS = [
    ("p1", "openai", "Plus", "subscription", "USD", 20.0, 20.0, "priced", True),
    ("p2", "openai", "Enterprise", "subscription", "USD", None, None, "contact_sales", False),
    ("p3", "kiro", "Free", "coding_plan", "USD", 0.0, 0.0, "priced", False),
    ("p4", "qwen", "Lite", "coding_plan", "CNY", 39.0, 39.0, "priced", False),
]


@pytest.fixture(scope="module")
def rows(spark):
    rates = spark.createDataFrame([("USD", 7.0, "d"), ("CNY", 1.0, "d"), ("BAD", -1.0, "d")], "currency string, rate double, published_date string")
    offers = fx.compare_offers(as_offers(spark.createDataFrame(OFFERS, KIND)), rates)
    kind = "plan_id string, provider_id string, product_name string, billing_type string, currency string, price_amount double, monthly_equivalent double, price_status string, featured_on_home boolean"
    plans = fx.compare_plans(as_plans(spark.createDataFrame(PLANS, kind)), rates)
    return C.view_rows(offers, plans).cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_comparison_leaves_quoted_prices_and_nulls(rows):
    got = {r["id"]: (r["input_per_1m"], r["compare_input"], r["compare_cache_read"], r["compare_monthly"]) for r in rows.collect()}
    assert got["o1"] == (1.0, 7.0, None, None) and got["o4"][:2] == (None, None) and got["o5"][:2] == (2.0, None)
    assert got["p1"][3] == 140.0 and got["p2"][3] is None and got["p3"][3] == 0.0


@pytest.mark.parametrize(("asked", "found"), [
    (C.CatalogQuery(search=" gpt "), ["o1", "o2"]),
    (C.CatalogQuery(providers=("qwen",), billing_types=("per_token",)), ["o4", "o3"]),
    (C.CatalogQuery(modalities=("vision",)), ["o1"]),
    (C.CatalogQuery(context="gte200k", sort="contextWindow:asc"), ["o1", "o2"]),
    (C.CatalogQuery(context="lt128k"), ["o4"]),
    (C.CatalogQuery(price="lt10", sort="inputPrice:asc"), ["o3", "o1"]),
    (C.CatalogQuery(market="global", billing_types=("per_token",), sort="releaseDate:desc"), ["o4", "o1", "o2", "o5"]),
    (C.CatalogQuery(billing_types=("per_token",), sort="inputPrice:desc"), ["o2", "o1", "o3", "o4", "o5"]),
    (C.CatalogQuery(billing_types=("per_token",), sort="inputPrice:asc"), ["o3", "o1", "o2", "o4", "o5"]),
    (C.CatalogQuery(billing_types=("per_token",), sort="releaseDate:asc"), ["o2", "o1", "o4", "o3", "o5"]),
    (C.CatalogQuery(currency="CNY", billing_types=("coding_plan",)), ["p4"]),
    (C.CatalogQuery(billing_types=("per_token",), sort="inputPrice:asc", page=2, page_size=2), ["o2", "o4"]),
    (C.CatalogQuery(billing_types=("per_token",), sort="inputPrice:asc", page=99, page_size=2), ["o5"]),
])
def test_catalog_pages(rows, asked, found):
    assert ids(asked.run(rows)) == found


def test_generic_table_counts_missing_numbers_as_endless(rows):
    offers = rows.where("billing_type = 'per_token'")
    assert ids(offers.orderBy(*C.table_order("input_per_1m", "desc")))[0] == "o4"
    assert ids(offers.orderBy(*C.table_order("input_per_1m", "asc")))[-1] == "o4"


def test_a_plan_without_a_price_is_neither_free_nor_paid(rows):
    plans = rows.where("billing_type <> 'per_token'")
    assert ids(plans.where(C.plan_kind("free"))) == ["p3"]
    assert sorted(ids(plans.where(C.plan_kind("paid")))) == ["p1", "p4"]


def test_facets_tabs_and_flags(rows):
    assert [(r["provider_id"], r["n"]) for r in C.facet_counts(rows, "provider_id").collect()][0] == ("openai", 4)
    assert [(r["billing_type"], r["n"]) for r in C.billing_tabs(rows).collect()] == [("per_token", 5), ("subscription", 2), ("coding_plan", 2)]
    flags = {r["provider_id"]: (r["has_per_token"], r["has_coding_plan"], r["n_models"]) for r in C.provider_flags(rows).collect()}
    assert flags["qwen"] == (True, True, 3) and flags["kiro"] == (False, True, 1)
    assert [r["modalities"] for r in C.distinct_values(rows, "modalities").collect()] == ["text", "vision"]
    assert C.default_currency(rows.where("billing_type <> 'per_token'")).first()["opens"] == "USD"


def test_flagships_prefer_the_line_over_the_date(rows):
    assert ids(C.flagships(rows)) == ["o2", "o3"]


def test_selection_keeps_order_and_drops_the_missing(rows):
    assert ids(C.selected(rows, ["o3", "gone", "o1", "o3"])) == ["o3", "o1"]
    assert ids(C.filled_selection(rows, ["gone", "o2"], ["o2", "o1", "o3"])) == ["o2", "o1", "o3"]
    assert "o1" not in ids(C.not_selected(rows, ["o1"]))


def test_lowest_needs_two_prices(rows):
    flagged = {r["id"]: r["lowest_compare_input"] for r in C.with_lowest(rows.where("id in ('o1', 'o3', 'o4')"), "compare_input").collect()}
    assert flagged == {"o1": False, "o3": True, "o4": False}
    assert not any(r["lowest_compare_input"] for r in C.with_lowest(rows.where("id in ('o1', 'o4')"), "compare_input").collect())
    assert ids(C.lowest_priced(rows)) == ["o3"]


def test_groups_first_rows_and_preferred(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, "b", "z"), (4, "c", "x")], "k int, g string, label string")
    assert [(r["g"], [x["label"] for x in r["rows"]]) for r in C.groups_in_order(df, "g", "k", "label").collect()] == [("b", ["x", "z"]), ("a", ["y"]), ("c", ["x"])]
    assert [r["k"] for r in C.first_of_each(df, "g", [df.k], 2, [1], "k").collect()] == [2, 3]
    assert [r["label"] for r in C.preferred_first(df, ["z"], "label", "k").collect()] == ["z", "x", "y"]


def test_provider_directory_and_info(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names], "provider_id string")
    metadata = spark.createDataFrame([("a", "A", None, None, None), ("m", "M", "Em", "us", "w")], "provider_id string, name string, name_en string, region string, website string")
    got = {r["provider_id"]: r["rank"] for r in C.provider_directory(one("a", "cursor"), one("a", "s"), metadata).collect()}
    assert got == {"a": 0, "s": 1, "m": 2}
    info = {r["provider_id"]: tuple(r)[1:] for r in C.with_provider_info(one("a", "m", "x"), metadata).collect()}
    assert info == {"a": ("A", "A", "unknown", ""), "m": ("M", "Em", "us", "w"), "x": ("x", "x", "unknown", "")}
    assert {r["provider_id"]: r["n_rows"] for r in C.providers_with_rows(one("a", "e"), one("a", "a", "n")).collect()} == {"a": 2, "n": 1}


def test_lookups(spark, rows):
    assert ids(C.row_by_id(rows, "o2")) == ["o2"] and ids(C.row_by_id(rows, "gone")) == []
    a = spark.createDataFrame([("x", "X")], "provider_id string, name string")
    b = spark.createDataFrame([("x", "other"), ("y", "Y")], "provider_id string, name string")
    assert [[r["name"] for r in C.current_provider(k, a, b).collect()] for k in ("x", "y", "z")] == [["X"], ["Y"], []]


def test_page_count():
    assert [C.page_count(n, 50) for n in (0, 1, 50, 51)] == [1, 1, 1, 2]


def test_visible_columns_and_flagship_lines(spark):
    assert C.toggled(("a", "b"), "a") == ("b",) and C.toggled(("b",), "b") == ("b",) and C.toggled(("b",), "a") == ("b", "a")
    names = {"openai": ["GPT-5.6 Sol", "GPT-5"], "anthropic": ["Claude Opus 5"], "google": ["Gemini 3 Pro Preview"], "qwen": ["Qwen4-Max"], "deepseek": ["DeepSeek V4 Pro", "DeepSeek V4"], "moonshot": ["Kimi K3.1"], "zhipu": ["GLM-5.2"], "minimax": ["MiniMax-M3"]}
    others = ["GPT-5 mini", "Claude Opusculum", "Gemini Flash", "Qwen4 Plus", "DeepSeek V4 Flash", "Kimi K3 Code", "GLM-5 Air", "MiniMax-M3 fast"]
    models = spark.createDataFrame([(p, n) for p, ns in names.items() for n in ns] + list(zip(names, others)), "provider_id string, model string")
    hit = models.join(C.lines_table(spark), F.col("provider_id") == F.col("rule_provider")).where(C.in_line("model"))
    assert {r["model"] for r in hit.collect()} == {n for ns in names.values() for n in ns}


def test_model_names(spark):
    rows = spark.createDataFrame([("GPT-5.2 Sol",), ("Claude Opus",), ("",), (None,), ("4o",), ("Kimi K2.5.1",)], "model string")
    got = [tuple(r) for r in rows.select(name_parts("model").alias("p")).select("p.stem", "p.version", "p.rest", "p.words").collect()]
    assert got[0] == ("gpt-", "5.2", " sol", ["gpt", "5", "2", "sol"]) and got[1][:3] == ("claude opus", None, "") and got[2][:3] == ("", None, "")
    assert got[3] == (None, None, None, None) and got[4][:3] == ("", "4", "o") and got[5][:3] == ("kimi k", "2.5", ".1")


def test_quick_filters_and_the_comparison_picker(spark):
    rows = spark.createDataFrame([("a", 9.9, 200_000, ["text", "vision"]), ("b", 10.0, 199_999, ["text"]), ("c", None, None, None)], "id string, compare_input double, context_window long, modalities array<string>")
    assert {q: [r["id"] for r in rows.where(C.quick_filter(q)).collect()] for q in ("under10", "longContext", "vision")} == {"under10": ["a"], "longContext": ["a"], "vision": ["a"]}
    many = spark.createDataFrame([(f"m{k}", "per_token", "p", "P", f"Model {k}", "2026") for k in range(90)], "id string, billing_type string, provider_id string, provider_name string, model string, release_date string")
    assert C.compare_candidates(many, elsewhere=("m1",)).count() == 40 and C.candidates(many).count() == 60


def test_stale_rows_are_no_candidates(spark):
    rows = spark.createDataFrame([("a", "per_token", "p", "P", "m1", "2025-01-01"), ("b", "per_token", "q", "Q", "m2", "2025-02-01"), ("c", "per_token", "p", "P", "m3", None)], "id string, billing_type string, provider_id string, provider_name string, model string, release_date string")
    statuses = spark.createDataFrame([("q", "failed", True), ("z", "ok", None)], "provider_id string, status string, stale boolean")
    marked = C.with_status(rows, statuses)
    assert [r["id"] for r in C.candidates(marked).collect()] == ["a", "c"] and [r["id"] for r in C.candidates(rows, without=("b",)).collect()] == ["a", "c"]
    assert C.shown(marked, ("stale",)).columns == ["id", "model", "stale"] and C.status_totals(statuses).first().asDict() == {"n_stale": 1, "n_fresh": 1}
