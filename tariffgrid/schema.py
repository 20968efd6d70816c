"""Row types of token offers and subscription plans, their defaults and their enumerations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Column types of an offer, in order. raw is the source record as JSON text.
OFFER_FIELDS: dict[str, str] = {
    **dict.fromkeys(("offer_id", "directory_provider_id", "provider_id", "provider_name", "model_id", "model_name", "region", "service_tier", "currency", "price_unit"), "string"),
    **dict.fromkeys(("input_per_1m", "output_per_1m", "cache_read_per_1m", "cache_write_per_1m"), "double"),
    **dict.fromkeys(("context_window", "max_output_tokens"), "bigint"),
    "modalities": "array<string>",
    **dict.fromkeys(("knowledge_cutoff", "release_date", "source_url", "source_updated_at", "fetched_at", "market", "access_channel", "pricing_condition", "source_id", "comparison_currency"), "string"),
    "comparison_fx_rate": "double",
    "comparison_fx_date": "string",
    **dict.fromkeys(("comparison_input_per_1m", "comparison_output_per_1m", "comparison_cache_read_per_1m", "comparison_cache_write_per_1m"), "double"),
    "raw": "string",
}
OFFER_DEFAULTS = {
    "region": "global", "service_tier": "standard", "currency": "USD", "price_unit": "per_1m_tokens", "fetched_at": "", "market": "global",
    "access_channel": "unspecified_endpoint", "pricing_condition": "standard", "source_id": "models_dev", "comparison_currency": "CNY", "raw": "{}",
}

PLAN_FIELDS: dict[str, str] = {
    **dict.fromkeys(("plan_id", "provider_id", "provider_name", "product_name", "plan_category", "billing_type"), "string"),
    "is_free": "boolean",
    **dict.fromkeys(("currency", "billing_cadence", "source_url", "source_kind", "fetched_at"), "string"),
    **dict.fromkeys(("price_amount", "monthly_equivalent", "first_period_price", "included_quota"), "double"),
    **dict.fromkeys(("quota_unit", "quota_period"), "string"),
    **dict.fromkeys(("features", "supported_models"), "array<string>"),
    **dict.fromkeys(("purchase_url", "source_updated_at"), "string"),
    "featured_on_home": "boolean",
    **dict.fromkeys(("market", "seat_type"), "string"),
    "minimum_seats": "bigint",
    **dict.fromkeys(("price_status", "price_scope", "comparison_currency"), "string"),
    "comparison_fx_rate": "double",
    "comparison_fx_date": "string",
    "comparison_monthly_amount": "double",
    "raw": "string",
    #: The registry entry the row came from: last-known-good rows are found by it.
    "source_id": "string",
}
PLAN_DEFAULTS = {
    "is_free": False, "currency": "USD", "billing_cadence": "monthly", "purchase_url": "", "featured_on_home": False, "market": "global",
    "price_status": "priced", "price_scope": "per_account", "comparison_currency": "CNY", "raw": "{}",
}

#: Fixed values of the enumerated columns.
BILLING_TYPES = ("subscription", "coding_plan")
PLAN_CATEGORIES = ("general_ai", "coding_tool", "developer_api")
PRICE_STATUSES = ("priced", "free", "contact_sales", "usage_based")
PRICE_SCOPES = ("per_account", "per_user", "per_seat", "usage_based")


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


def conform(df: DataFrame, fields: dict[str, str], defaults: dict) -> DataFrame:
    """Exactly the fields, in order and type: absent columns and nulls take their default, others are dropped.

    This is also how older tables are read: columns added since then appear with defaults.
    """
    have = set(df.columns)

    def column(name: str, kind: str):
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name in defaults:
            value = F.coalesce(value, F.lit(defaults[name]).cast(kind))
        elif kind == "array<string>":
            value = F.coalesce(value, F.array().cast(kind))
        return value.alias(name)

    return df.select(*(column(n, k) for n, k in fields.items()))


def as_offers(df: DataFrame) -> DataFrame:
    return conform(df, OFFER_FIELDS, OFFER_DEFAULTS)


def as_plans(df: DataFrame) -> DataFrame:
    return conform(df, PLAN_FIELDS, PLAN_DEFAULTS)
