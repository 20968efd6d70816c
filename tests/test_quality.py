import pytest

from tariffgrid.operators import quality as Q
from tariffgrid.plans.history import drop_ratios, with_release_status
from tariffgrid.schema import as_offers, as_plans

OFFER = {"offer_id": "a/m", "provider_id": "a", "model_id": "m", "model_name": "M", "currency": "USD", "input_per_1m": 1.0, "output_per_1m": 2.0}
PLAN = {
    "plan_id": "p/x", "provider_id": "p", "product_name": "X", "plan_category": "general_ai", "billing_type": "subscription", "is_free": False, "source_url": "u", "price_amount": 5.0,
}


def offers(spark, *rows):
    kind = "offer_id string, provider_id string, model_id string, model_name string, currency string, input_per_1m double, output_per_1m double, cache_read_per_1m double, market string"
    return as_offers(spark.createDataFrame([OFFER | r for r in rows], kind))


def plans(spark, *rows):
    kind = (
        "plan_id string, provider_id string, product_name string, plan_category string, billing_type string, is_free boolean, source_url string, price_amount double, "
        "monthly_equivalent double, price_status string, price_scope string, market string"
    )
    return as_plans(spark.createDataFrame([PLAN | r for r in rows], kind))


@pytest.mark.parametrize(("row", "rule"), [
    ({"provider_id": ""}, "identity"), ({"model_name": None}, "identity"), ({"currency": "usd"}, "currency"), ({"currency": "US"}, "currency"), ({"market": ""}, "market"),
    ({"input_per_1m": None, "output_per_1m": None}, "price_missing"), ({"cache_read_per_1m": -0.1}, "price_negative"),
])
def test_offer_rules(spark, row, rule):
    with pytest.raises(Q.GateError, match=rule):
        Q.check_offers(offers(spark, row))


@pytest.mark.parametrize(("row", "rule"), [
    ({"source_url": ""}, "identity"), ({"billing_type": "x"}, "billing_type"), ({"plan_category": "x"}, "plan_category"), ({"price_status": "x"}, "price_status"), ({"price_scope": "x"}, "price_scope"),
    ({"price_amount": -1.0}, "price_negative"), ({"is_free": True}, "free_price"), ({"is_free": True, "price_amount": None}, "free_price"), ({"price_status": "free", "price_amount": 0.0}, "free_status"),
    ({"price_status": "contact_sales"}, "open_price"),
])
def test_plan_rules(spark, row, rule):
    with pytest.raises(Q.GateError, match=rule):
        Q.check_plans(plans(spark, row))


def test_order_of_failures(spark):
    both = offers(spark, {"offer_id": "b", "currency": "x", "market": ""}, {"offer_id": "a", "market": ""})
    with pytest.raises(Q.GateError, match="at least 3"):
        Q.check_offers(both, minimum=3)
    with pytest.raises(Q.GateError, match="market: a"):
        Q.check_offers(both)
    with pytest.raises(Q.GateError, match="repeated offer_id: a"):
        Q.check_offers(offers(spark, {"offer_id": "a"}, {"offer_id": "a", "currency": "x"}))


def test_drop_at_the_limit_passes_and_above_fails(spark):
    eight = offers(spark, *({"offer_id": str(k)} for k in range(8)))
    assert Q.check_offers(eight, previous=10).count() == 8
    with pytest.raises(Q.GateError, match="dropped from 11"):
        Q.check_offers(eight, previous=11)
    assert Q.drop_ratio(5, None) is None and Q.drop_ratio(5, 0) is None and Q.drop_ratio(12, 10) == 0


def test_a_valid_zero_price_passes(spark):
    assert Q.check_offers(offers(spark, {"input_per_1m": 0.0})).count() == 1
    assert Q.check_plans(plans(spark, {"is_free": True, "price_amount": 0.0, "price_status": "free"})).count() == 1


def test_source_report_and_health(spark):
    rows = plans(spark, {"plan_id": "a"}, {"plan_id": "b", "price_amount": None}).withColumnRenamed("source_id", "old").selectExpr("*", "'s' as source_id").drop("old")
    expected = spark.createDataFrame([("s", 2), ("t", 1)], "source_id string, minimum int")
    got = {r["source_id"]: (r["n"], r["n_missing"], r["healthy"]) for r in Q.source_report(rows, expected, exact=True).collect()}
    assert got == {"s": (2, 1, False), "t": (0, 0, False)}
    told = Q.health(Q.source_report(rows, expected)).first()
    assert (told["n_sources"], told["n_healthy"], told["n_rows"], told["status"]) == (2, 1, 2, "degraded")


def test_release_status_and_drop_ratios(spark):
    releases = spark.createDataFrame([("r1", "t1"), ("r2", "t2"), ("r3", "t2")], "release_id string, published_at string")
    assert {r["release_id"]: r["status"] for r in with_release_status(releases).collect()} == {"r1": "superseded", "r2": "superseded", "r3": "published"}
    counts = spark.createDataFrame([("a", 10), ("b", 8), ("c", 9)], "at string, n long")
    assert [r["drop_ratio"] for r in drop_ratios(counts, "at", "n").orderBy("at").collect()] == [None, 0.2, 0.0]


def test_older_tables_get_defaults_for_columns_added_since(spark):
    row = as_offers(spark.createDataFrame([("a", "b")], "offer_id string, provider_id string")).first()
    assert (row["market"], row["service_tier"], row["modalities"], row["cache_read_per_1m"]) == ("global", "standard", [], None)
