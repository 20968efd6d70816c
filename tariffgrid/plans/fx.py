"""Exchange rates of one snapshot, and comparison prices derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffgrid.functions.pricing import number

COMPARISON = "CNY"
OFFER_PRICES = ("input_per_1m", "output_per_1m", "cache_read_per_1m", "cache_write_per_1m")


def read_rates(spark: SparkSession, path: str, base: str = COMPARISON) -> DataFrame:
    """(currency, rate, published_date) from a JSON object of base, date and rates.

    rate turns an amount of the currency into the comparison currency. Codes are upper-cased
    and the document's own base counts as 1; rates that are no positive number are left
    out. A document without base, date, or a rate of the comparison currency is an error.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    doc = raw.select(
        F.upper(F.try_variant_get("v", "$.base", "string")).alias("own"),
        F.try_variant_get("v", "$.date", "string").alias("published_date"),
        F.try_variant_get("v", "$.rates", "map<string,variant>").alias("rates"),
    )
    bad = F.col("own").isNull() | F.col("published_date").isNull() | F.col("rates").isNull()
    found = doc.select("own", "published_date", bad.alias("bad"), F.map_entries("rates").alias("e"))
    if found.where("bad").head(1) or not found.head(1):
        raise ValueError("exchange rates need base, date and rates")
    each = found.select("own", "published_date", F.explode("e").alias("e")).select("own", "published_date", F.upper("e.key").alias("currency"), number(F.try_variant_get(F.col("e.value"), "$", "string")).alias("per_base"))
    own = found.select("own", "published_date", F.col("own").alias("currency"), F.lit(1.0).alias("per_base"))
    each = each.where("currency <> own").unionByName(own).where("per_base > 0").groupBy("published_date", "currency").agg(F.max("per_base").alias("per_base"))
    to_base = each.where(F.col("currency") == base).head(1)
    if not to_base:
        raise ValueError(f"exchange rates hold no {base}")
    rate = F.when(F.col("currency") == base, 1.0).otherwise(F.lit(to_base[0]["per_base"]) / F.col("per_base"))
    return each.select("currency", rate.alias("rate"), "published_date")


def with_rate(rows: DataFrame, rates: DataFrame, currency: str = "currency") -> DataFrame:
    """rows with comparison_fx_rate and comparison_fx_date of their currency; null where there is no rate.

    rates holds one row a currency; how it is joined is left to its size.
    """
    few = rates.where("rate > 0").select(F.col("currency").alias("rate_of"), F.col("rate").alias("comparison_fx_rate"), F.col("published_date").alias("comparison_fx_date"))
    plain = rows.drop("comparison_fx_rate", "comparison_fx_date")
    return plain.join(few, F.upper(currency) == F.col("rate_of"), "left").drop("rate_of")


def reference_date(rows: DataFrame) -> DataFrame:
    """One row: the newest date of the rates that the rows' comparison prices rest on, and of how many rows; null and 0 if none has one."""
    return rows.agg(F.max("comparison_fx_date").alias("reference_date"), F.count("comparison_fx_date").alias("n_rows"))


def compare_offers(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Offers with their four prices in the comparison currency; the quoted prices stay as they are."""
    rated = with_rate(offers, rates)
    new: dict[str, Column] = {f"comparison_{c}": F.col(c) * F.col("comparison_fx_rate") for c in OFFER_PRICES}
    return rated.withColumns(new | {"comparison_currency": F.lit(COMPARISON)})


def plan_amount() -> Column:
    """What a plan costs a month: its monthly equivalent, or its price if paid monthly; null unless priced or free."""
    monthly = F.coalesce("monthly_equivalent", F.when(F.col("billing_cadence") == "monthly", F.col("price_amount")))
    return F.when(F.col("price_status").isin("priced", "free"), monthly)


def compare_plans(plans: DataFrame, rates: DataFrame) -> DataFrame:
    """Plans with their monthly amount in the comparison currency; the currency is null where no rate is known."""
    rated = with_rate(plans, rates)
    return rated.withColumns({
        "comparison_monthly_amount": plan_amount() * F.col("comparison_fx_rate"),
        "comparison_currency": F.when(F.col("comparison_fx_rate").isNotNull(), COMPARISON),
    })
