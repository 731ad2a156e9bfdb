"""Prices and numbers from text, currencies, unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartmill.vocabulary import FX_TO_PLN

#: Fixed: a price with its currency, thousands set apart by a space or no-break space.
PRICE = "(?i)(\\d{1,3}(?:[  ]\\d{3})*(?:[.,]\\d{1,2})?)\\s*(?:zł|pln)"
BARE_PRICE = r"^\s*(\d+(?:[.,]\d{1,2})?)\s*$"


def parse_price(text: Column) -> Column:
    """A price with its currency, else a text that is one number; null for zero and all else."""
    t = F.coalesce(text, F.lit(""))
    found = F.coalesce(F.nullif(F.regexp_extract(t, PRICE, 1), F.lit("")), F.nullif(F.regexp_extract(t, BARE_PRICE, 1), F.lit("")))
    value = F.translate(found, ",  ", ".").try_cast("double")
    return F.when(value > 0, value)


def lenient_float(text: Column, default: float | None = None) -> Column:
    """A number with comma or dot; the default for null, empty and unreadable text."""
    value = F.translate(F.trim(text.cast("string")), ",", ".").try_cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def to_pln(amount: Column, currency: Column) -> Column:
    rates = F.create_map(*[F.lit(x) for pair in FX_TO_PLN.items() for x in pair])
    return F.round(amount * F.coalesce(F.try_element_at(rates, F.upper(currency)), F.lit(1.0)), 2)


def unit_price(price: Column, base_value: Column) -> Column:
    return F.when(base_value > 0, F.round(price / base_value, 4))


def minor_units(value: Column, digits: Column) -> Column:
    """A price in minor units; two digits if not said."""
    return F.round(value.try_cast("double") / F.pow(F.lit(10.0), F.coalesce(digits, F.lit(2))), 2)


def grams(weight: Column, unit: Column) -> Column:
    """Whole grams of a weight in g, kg, lbs or oz; null for nothing or 0."""
    factors = {"g": 1.0, "kg": 1000.0, "lbs": 453.592, "oz": 28.3495}
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in factors.items() for x in p]), F.lower(unit)), F.lit(1.0))
    return F.nullif(F.bround(weight.try_cast("double") * factor).cast("int"), F.lit(0))


def drift(live: Column, stored: Column) -> Column:
    """match within 0.011, changed within 35 %, check beyond, unreachable without a live price."""
    apart = F.abs(live - stored)
    return F.when(live.isNull(), "unreachable").when(apart < 0.011, "match").when(apart <= 0.35 * stored, "changed").otherwise("check")
