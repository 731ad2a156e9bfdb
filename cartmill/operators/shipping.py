"""Delivery quotes by weight bands as expressions over a struct of rules, without a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartmill.vocabulary import DEFAULT_GRAMS

BAND = "struct<max_kg:double,price:double>"
METHOD = f"struct<name:string,transit_days:array<int>,estimated:boolean,bands:array<{BAND}>>"
RULES = f"struct<confidence:string,max_order_kg:double,free_over:double,handling_days:array<int>,methods:array<{METHOD}>>"
QUOTE = "struct<cost:double,method:string,eta_min:int,eta_max:int,over_limit:boolean,free:boolean,estimated:boolean>"


def band_price(bands: Column, kg: Column) -> Column:
    """struct(price, over): the cheapest band that carries the weight, else the widest band's price for as many parcels as it takes."""
    fit = F.array_min(F.transform(F.filter(bands, lambda b: kg <= b["max_kg"]), lambda b: b["price"]))
    top = F.array_max(F.transform(bands, lambda b, i: F.struct(b["max_kg"].alias("max_kg"), (-i).alias("i"), b["price"].alias("price"))))
    parcels = F.greatest(F.lit(1), F.ceil(kg / top["max_kg"]))
    return F.struct(F.coalesce(fit, top["price"] * parcels).alias("price"), fit.isNull().alias("over"))


def quote(rules: Column, subtotal: Column, grams: Column) -> Column:
    """The cheapest method's cost (the first of equals), its days and flags; null without rules or methods."""
    kg = grams / 1000.0
    usable = F.filter(F.coalesce(rules["methods"], F.array().cast(f"array<{METHOD}>")), lambda m: F.size(F.coalesce(m["bands"], F.array().cast(f"array<{BAND}>"))) > 0)
    priced = F.transform(usable, lambda m, i: F.struct(band_price(m["bands"], kg).alias("b"), i.alias("i"), m.alias("m")))
    # structs compare field by field, so the least is the cheapest, then the first
    best = F.get(F.array_sort(priced, lambda x, y: F.when(x["b"]["price"] < y["b"]["price"], -1).when(x["b"]["price"] > y["b"]["price"], 1).otherwise(x["i"] - y["i"])), F.lit(0))
    transit = F.coalesce(best["m"]["transit_days"], F.array(F.lit(3), F.lit(7)))
    handling = F.coalesce(rules["handling_days"], F.array(F.lit(0), F.lit(0)))
    free = F.coalesce(subtotal >= rules["free_over"], F.lit(False))
    out = F.struct(
        F.when(free, F.lit(0.0)).otherwise(best["b"]["price"]).alias("cost"),
        F.coalesce(best["m"]["name"], F.lit("Shipping")).alias("method"),
        (F.element_at(transit, 1) + F.element_at(handling, 1)).alias("eta_min"),
        (F.element_at(transit, -1) + F.element_at(handling, -1)).alias("eta_max"),
        (best["b"]["over"] | F.coalesce(kg > rules["max_order_kg"], F.lit(False))).alias("over_limit"),
        free.alias("free"),
        F.coalesce(best["m"]["estimated"], F.coalesce(rules["confidence"], F.lit("low")) != "high").alias("estimated"),
    ).cast(QUOTE)
    return F.when(rules.isNotNull() & best.isNotNull(), out)


def eta_label(low: Column, high: Column) -> Column:
    return F.when(low == high, F.concat(low.cast("string"), F.lit(" d"))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" d")))


def item_grams(grams: Column, quantity: Column) -> Column:
    """An item's weight; 500 g where it is null or 0."""
    return F.coalesce(F.nullif(grams, F.lit(0)), F.lit(DEFAULT_GRAMS)) * quantity


def to_free(rules: Column, subtotal: Column) -> Column:
    """What is missing to free delivery; null where there is none."""
    return F.when(F.coalesce(rules["free_over"], F.lit(0.0)) != 0, F.greatest(F.round(rules["free_over"] - subtotal, 2), F.lit(0.0)))
