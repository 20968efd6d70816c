"""Scalar column functions over prices, plans, contexts and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of currencies, kinds of quota units, and labels of enumerated values.
CURRENCY_SIGNS = {"USD": "$", "CNY": "¥", "EUR": "€", "SGD": "S$"}
QUOTA_TYPES = {
    "credits": "credits", "credit": "credits", "calls": "calls", "requests": "calls", "prompts": "prompts", "afp": "afp", "usd": "monetary", "cny": "monetary", "base": "base",
}
BILLING_LABELS = {"per_token": "按量计费", "subscription": "订阅套餐", "coding_plan": "编程套餐"}
MARKET_LABELS = {
    "global": "全球", "cn_mainland": "中国大陆", "cn_beijing": "华北 2（北京）", "us_virginia": "美国（弗吉尼亚）", "sg_international": "新加坡",
    "de_frankfurt": "德国（法兰克福）", "jp_tokyo": "日本（东京）",
}
CONDITION_LABELS = {"standard": "标准", "off_peak": "空闲时段", "peak": "高峰时段"}
SAME_PRICE = 1e-9


def lookup(value: Column, table: dict, default: Column | str | None = None) -> Column:
    """table[value], or the default: by itself the value as it is."""
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    other = value if default is None else default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(entries, value), other)


def number(value: Column) -> Column:
    """Text as a double; null for null, empty and anything that is no plain number."""
    text = F.trim(value.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def integer(value: Column) -> Column:
    """The number cut towards zero."""
    return number(value).try_cast("bigint")


def positive(value: Column) -> Column:
    return F.when(number(value) > 0, number(value))


def service_tier(model_id: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", model_id, F.coalesce(name, F.lit(""))))
    return F.when(text.contains("batch"), "batch").when(text.contains("flex"), "flex").otherwise("standard")


def offer_id(*parts: Column) -> Column:
    """Parts joined by slashes, the second without slashes at its ends."""
    first, second, *rest = parts
    return F.concat_ws("/", first, F.btrim(second, F.lit("/")), *rest)


def distinct_in_order(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)))


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no spaces; null for text that is no JSON."""
    return F.to_json(F.try_parse_json(text))


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def compare_price(comparison: Column, currency: Column, price: Column, base: str = "CNY") -> Column:
    """Price in the comparison currency: as derived, or the price itself where it is quoted in that currency. Missing stays null."""
    return F.coalesce(comparison, F.when(currency == base, price))


def quota_type(unit: Column) -> Column:
    return lookup(F.lower(F.trim(unit)), QUOTA_TYPES, "other")


def _decimals(value: Column, most: int) -> Column:
    """Thousands separators and at most so many decimals, without trailing zeros."""
    text = F.format_number(value, most)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if most else text


def format_price(value: Column, currency: Column) -> Column:
    """`—` for null, else sign (or code and space) and amount with up to 4 decimals below 1, else 2."""
    sign = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in CURRENCY_SIGNS.items() for x in p)), currency), F.concat(currency, F.lit(" ")), F.lit(""))
    return F.when(value.isNull(), "—").otherwise(F.concat(sign, F.when(F.abs(value) < 1, _decimals(value, 4)).otherwise(_decimals(value, 2))))


def format_plan_price(monthly: Column, currency: Column) -> Column:
    """`—` for null, `免费` for 0, one decimal at most from 100 on, else two."""
    sign = lookup(currency, CURRENCY_SIGNS, F.concat(F.coalesce(currency, F.lit("")), F.lit(" ")))
    return F.when(monthly.isNull(), "—").when(monthly == 0, "免费").otherwise(F.concat(sign, F.when(monthly >= 100, _decimals(monthly, 1)).otherwise(_decimals(monthly, 2))))


def format_reference(value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("≈ ¥"), _decimals(value, 2)))


def format_context(tokens: Column) -> Column:
    """`—` for null, millions with a decimal only if there is one, thousands rounded, else the number."""
    millions = tokens / 1_000_000.0
    whole = F.pmod(tokens, F.lit(1_000_000)) == 0
    return (
        F.when(tokens.isNull(), "—")
        .when(tokens >= 1_000_000, F.concat(F.when(whole, millions.cast("bigint").cast("string")).otherwise(F.format_string("%.1f", millions)), F.lit("M")))
        .when(tokens >= 1_000, F.concat(F.floor(tokens / 1_000.0 + 0.5).cast("string"), F.lit("K")))
        .otherwise(tokens.cast("string"))
    )


def format_quota(amount: Column, unit: Column, period: Column) -> Column:
    return F.when(amount.isNull(), "—").otherwise(F.concat_ws(" ", _decimals(amount, 2), unit, F.when(period.isNotNull(), F.concat(F.lit("/ "), period))))


def market_label(market: Column) -> Column:
    return lookup(market, MARKET_LABELS)


def condition_label(condition: Column) -> Column:
    """Known conditions by label, input brackets as `输入 ≤ X` or `输入 > X`, others as they are."""
    up, over = (F.upper(F.regexp_extract(condition, p, 1)) for p in (r"^input_lte_(.+)$", r"^input_gt_(.+)$"))
    brackets = F.when(up != "", F.concat(F.lit("输入 ≤ "), up)).when(over != "", F.concat(F.lit("输入 > "), over)).otherwise(condition)
    return lookup(condition, CONDITION_LABELS, brackets)


def billing_label(billing_type: Column) -> Column:
    return lookup(billing_type, BILLING_LABELS)


def age_hours(then: Column, now: Column) -> Column:
    """Whole hours from then to now; never less than 0; null if then is no timestamp."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600.0)).cast("bigint")


def freshness(then: Column, now: Column) -> Column:
    hours = age_hours(then, now)
    return F.when(hours.isNull(), "未知").when(hours < 1, "刚刚").when(hours < 24, F.concat(hours.cast("string"), F.lit(" 小时前"))).otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" 天前")))


def note_text(note: Column) -> Column:
    """A note that is a JSON object tells its `text`; another note is text itself."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(note), "$.text", "string"), note)


def is_lowest(value: Column, lowest: Column) -> Column:
    return F.coalesce(F.abs(value - lowest) < SAME_PRICE, F.lit(False))


def source_status(stale: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "failed").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("healthy")
