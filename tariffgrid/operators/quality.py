"""Ordered quality gates: one aggregation finds the first rule that the first bad row breaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tariffgrid.schema import BILLING_TYPES, PLAN_CATEGORIES, PRICE_SCOPES, PRICE_STATUSES


class GateError(ValueError):
    """A table that must not be published."""


@dataclass(frozen=True)
class RowRule:
    name: str
    #: True where a row breaks the rule; null counts as kept.
    broken: Column


def _empty(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.coalesce(F.col(c), F.lit("")) == "")
    return bad


def _negative(*columns: str) -> Column:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return bad


def _not_in(column: str, values: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*values), F.lit(False))


def offer_rules() -> tuple[RowRule, ...]:
    """In the order in which a row is judged."""
    return (
        RowRule("identity", _empty("offer_id", "provider_id", "model_id", "model_name")),
        RowRule("currency", ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False))),
        RowRule("market", _empty("market", "access_channel", "pricing_condition", "source_id")),
        RowRule("price_missing", F.col("input_per_1m").isNull() & F.col("output_per_1m").isNull()),
        RowRule("price_negative", _negative("input_per_1m", "output_per_1m", "cache_read_per_1m", "cache_write_per_1m")),
    )


def plan_rules() -> tuple[RowRule, ...]:
    fixed = F.col("price_status").isin("contact_sales", "usage_based")
    return (
        RowRule("identity", _empty("plan_id", "provider_id", "product_name", "source_url")),
        RowRule("billing_type", _not_in("billing_type", BILLING_TYPES)),
        RowRule("plan_category", _not_in("plan_category", PLAN_CATEGORIES)),
        RowRule("price_status", _not_in("price_status", PRICE_STATUSES)),
        RowRule("price_scope", _not_in("price_scope", PRICE_SCOPES)),
        RowRule("market", _empty("market")),
        RowRule("price_negative", _negative("price_amount", "monthly_equivalent", "first_period_price", "included_quota")),
        RowRule("free_price", F.col("is_free") & ~F.coalesce(F.col("price_amount") == 0, F.lit(False))),
        RowRule("free_status", (F.col("price_status") == "free") & ~F.coalesce(F.col("is_free"), F.lit(False))),
        RowRule("open_price", fixed & (F.col("price_amount").isNotNull() | F.col("monthly_equivalent").isNotNull())),
    )


def first_broken(rules: tuple[RowRule, ...]) -> Column:
    """Name of the first rule that a row breaks, null if it keeps all."""
    return F.coalesce(*(F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules))


def rule_counts(rows: DataFrame, rules: tuple[RowRule, ...]) -> DataFrame:
    """One row: how many rows there are, and how many break each rule."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(r.broken, F.lit(False))).alias(r.name) for r in rules))


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_ratio(now: int | Column, before: int | Column):
    """Share of the rows before that are missing now; never less than 0."""
    if isinstance(now, Column) or isinstance(before, Column):
        return F.when(F.lit(before) > 0 if not isinstance(before, Column) else before > 0, F.greatest(F.lit(0), before - now) / before)
    return max(0, before - now) / before if before else None


def check(rows: DataFrame, key: str, rules: tuple[RowRule, ...], *, minimum: int = 1, previous: int | None = None, maximum_drop: float = 0.20, order: str | None = None) -> DataFrame:
    """rows, if they pass; else GateError of the first failure.

    Order: the least number of rows, repeated keys, the first bad row's first broken
    rule (rows in order of `order`, by default the key), the drop against the previous
    count. Two aggregations evaluate all of it.
    """
    name = first_broken(rules)
    gate = Gate(key, rules, minimum=minimum, previous=previous, maximum_drop=maximum_drop, order=order)
    gate.found = rows.agg(*gate.metrics()).first().asDict()
    gate.judge(rows)
    return rows


class Gate:
    """A table's rules measured by the very job that writes it, and judged from what it wrote.

    watched(rows) adds the metrics to whatever job consumes the rows: their number, and the first bad row
    with its first broken rule. judge(written) raises GateError of the first failure in the order of check();
    for repeated keys it reads the written key column alone, summed by task before any shuffle.
    """

    def __init__(self, key: str, rules: tuple[RowRule, ...], *, minimum: int = 1, previous: int | None = None, maximum_drop: float = 0.20, order: str | None = None):
        self.key, self.rules, self.minimum, self.previous, self.maximum_drop, self.order = key, rules, minimum, previous, maximum_drop, order or key
        self.observation: Observation | None = None
        self.found: dict | None = None

    def metrics(self) -> tuple[Column, ...]:
        name = first_broken(self.rules)
        return F.count(F.lit(1)).alias("n"), F.min(F.when(name.isNotNull(), F.struct(F.col(self.order).alias("at"), F.col(self.key).alias("key"), name.alias("rule")))).alias("bad")

    def watched(self, rows: DataFrame) -> DataFrame:
        self.observation = Observation()
        return rows.observe(self.observation, *self.metrics())

    def judge(self, written: DataFrame) -> int:
        """How many rows there are, if all is well."""
        found = self.found or self.observation.get
        if found["n"] < self.minimum:
            raise GateError(f"{found['n']} rows; at least {self.minimum} are needed")
        if repeated := duplicate_keys(written, self.key).orderBy(self.key).limit(5).collect():
            raise GateError(f"repeated {self.key}: {', '.join(str(r[self.key]) for r in repeated)}")
        if found["bad"]:
            raise GateError(f"{found['bad']['rule']}: {found['bad']['key']}")
        ratio = drop_ratio(found["n"], self.previous) if self.previous else None
        if ratio is not None and ratio > self.maximum_drop:
            raise GateError(f"count dropped from {self.previous} to {found['n']}")
        return found["n"]


def offer_gate(**limits) -> Gate:
    return Gate("offer_id", offer_rules(), **limits)


def plan_gate(**limits) -> Gate:
    return Gate("plan_id", plan_rules(), **limits)


def check_offers(offers: DataFrame, **limits) -> DataFrame:
    return check(offers, "offer_id", offer_rules(), **limits)


def check_plans(plans: DataFrame, **limits) -> DataFrame:
    return check(plans, "plan_id", plan_rules(), **limits)


def source_report(rows: DataFrame, expected: DataFrame, exact: bool = False) -> DataFrame:
    """For each expected source (source_id, minimum): rows found, prices missing, and whether it is healthy.

    exact: as many rows as expected, none without a price where its status is priced.
    """
    price = F.coalesce(F.col("price_amount"), F.col("monthly_equivalent")) if "price_amount" in rows.columns else F.coalesce("input_per_1m", "output_per_1m")
    status = F.col("price_status") if "price_status" in rows.columns else F.lit("priced")
    counts = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(price.isNull() & (status == "priced")).alias("n_missing"))
    joined = expected.join(counts, "source_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0))})
    healthy = (F.col("n") == F.col("minimum")) & (F.col("n_missing") == 0) if exact else F.col("n") >= F.col("minimum")
    return joined.select("source_id", "minimum", "n", "n_missing", healthy.alias("healthy"))


def health(report: DataFrame) -> DataFrame:
    """One row over a source report: sources, healthy ones, rows, and the overall status."""
    return report.agg(
        F.count(F.lit(1)).alias("n_sources"), F.count_if("healthy").alias("n_healthy"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.when(F.coalesce(F.bool_and("healthy"), F.lit(True)), "healthy").otherwise("degraded").alias("status"),
    )
