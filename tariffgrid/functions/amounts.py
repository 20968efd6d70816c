"""Prices in running text, read by a small grammar.

    mention = [lead] [sign] number [name] [period]

A lead (`monthly price:`) or a period (`/ user / mo`) makes a mention a monthly one; the
currency is told by a name after the number, else by a sign before it. Everything else
here picks from the mentions of a text, in their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tariffgrid.functions.pricing import lookup

#: Words of the grammar, and what they stand for.
SIGNS = {"us$": "USD", "s$": "SGD", "$": "USD", "usd": "USD", "sgd": "SGD", "¥": "CNY", "￥": "CNY", "cny": "CNY", "rmb": "CNY"}
NAMES = {"usd": "USD", "sgd": "SGD", "cny": "CNY", "rmb": "CNY", "美元": "USD", "元": "CNY"}
LEADS = ("monthly price", "monthly", "month price", "month", "每月", "月费")
EACH, SEATS, MONTHS = ("/", "per", "a", "每"), ("user", "seat", "member", "用户"), ("months", "month", "mo", "月")
MONTHLY_CURRENCIES = ("USD", "CNY")


def spelled(names: Iterable[str]) -> str:
    """A pattern of any of the names, longest first, each as whole words."""

    def guarded(name: str) -> str:
        before, after = (r"(?<!\w)" if name[0].isascii() and name[0].isalnum() else ""), (r"(?!\w)" if name[-1].isascii() and name[-1].isalnum() else "")
        return before + re.escape(name).replace(r"\ ", r"\s+") + after

    return "(?:" + "|".join(guarded(n) for n in sorted(names, key=len, reverse=True)) + ")"


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")"


NUMBER = r"\d[\d,]*(?:\.\d+)?"
_PERIOD = rf"(?:(?:{_any(EACH)}\s*{_any(SEATS)}\s*)?(?:{_any(EACH)}\s*1?\s*个?\s*{_any(MONTHS)}(?![a-z])|monthly))"


def mention_pattern(priced: bool = False) -> str:
    """The grammar as a pattern with the groups lead, sign, number, name and period; priced: of mentions with sign and period only."""
    some = "" if priced else "?"
    return rf"(?:({_any(LEADS)})\s*[:：-]?\s*)?({_any(SIGNS)}){some}\s*({NUMBER})\s*({_any(NAMES)})?\s*({_PERIOD}){some}"


def _amount(number: Column) -> Column:
    return F.replace(number, F.lit(","), F.lit("")).try_cast("double")


def mentions(text: Column) -> Column:
    """Every amount of a text as struct(amount, currency, monthly); the currency is null if none is told."""
    lead, sign, number, name, period = (F.regexp_extract_all(text, F.lit(f"(?iu){mention_pattern()}"), F.lit(g)) for g in range(1, 6))

    def one(m: Column) -> Column:
        currency = F.coalesce(lookup(F.lower(m["3"]), NAMES, F.lit(None).cast("string")), lookup(F.lower(m["1"]), SIGNS, F.lit(None).cast("string")))
        return F.struct(_amount(m["2"]).alias("amount"), currency.alias("currency"), ((m["0"] != "") | (m["4"] != "")).alias("monthly"))

    return F.transform(F.arrays_zip(lead, sign, number, name, period), one)


def amounts(text: Column, currency: str | None = None, monthly: bool = False) -> Column:
    """The amounts of a currency (or of any) in the order of the text; monthly: those that are told a month."""

    def fits(m: Column) -> Column:
        ok = F.coalesce(m["currency"] == currency, F.lit(False)) if currency else m["currency"].isNotNull()
        return ok & m["monthly"] if monthly else ok

    return F.transform(F.filter(mentions(text), fits), lambda m: m["amount"])


def first_amount(text: Column, currency: str, monthly: bool = False) -> Column:
    return F.get(amounts(text, currency, monthly), F.lit(0))


def monthly_price(text: Column, currency: Column, is_free: Column) -> Column:
    """Monthly price shown in a window of text; a free plan costs 0; another currency is an error."""
    wrong = F.raise_error(F.concat(F.lit("no price patterns for currency "), currency)).cast("double")
    price = F.when(is_free, F.lit(0.0))
    for code in MONTHLY_CURRENCIES:
        price = price.when(currency == code, first_amount(text, code, monthly=True))
    return price.otherwise(wrong)


def regional_price(text: Column) -> Column:
    """struct(price, currency) a month in the visitor's currency, else in dollars; null if none is shown."""
    found = ((c, first_amount(text, c, monthly=True)) for c in ("SGD", "USD"))
    return F.coalesce(*(F.when(x.isNotNull(), F.struct(x.alias("price"), F.lit(c).alias("currency"))) for c, x in found))


def labelled(text: Column, names: Iterable[str]) -> Column:
    """A label and the monthly price right after it, at most `at`, a bracket or a cell's end between them; null if there is none."""
    pattern = rf"(?iu){spelled(names)}[\s|(:：]*(?:at\s+)?{mention_pattern(priced=True)}"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def counted(text: Column, unit: str) -> Column:
    """The number that stands before a unit, without its thousands separators."""
    return _amount(F.regexp_extract(text, rf"(?i)({NUMBER})\s+{unit}s?(?!\w)", 1))


def cell_words(cell: Column, *starts: str) -> Column:
    """The first name in a cell, lower-cased, that begins so; null if none does."""
    words = F.split(F.lower(cell), r"[^a-z0-9._-]+")
    return F.get(F.filter(words, lambda w: F.greatest(*(w.startswith(s) for s in (*starts, starts[0])))), F.lit(0))


def free_or_amount(cell: Column) -> Column:
    """`Free` is 0; else the first dollar amount, escaped or not; else null."""
    text = F.trim(F.replace(cell, F.lit("\\"), F.lit("")))
    return F.when(F.lower(text) == "free", F.lit(0.0)).otherwise(first_amount(text, "USD"))


def last_amount(cell: Column, plain: Column) -> Column:
    """The last amount with a currency (a struck-through price comes first), else a bare number that fills the plain cell."""
    told = F.try_element_at(amounts(F.replace(cell, F.lit("\\"), F.lit(""))), F.lit(-1))
    return F.coalesce(told, _amount(F.trim(plain)))
