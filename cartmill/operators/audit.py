"""Audits: what stays uncategorised, and stored prices against live ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartmill.functions.numbers import drift


def shares(titles: DataFrame) -> DataFrame:
    """category, n, percent of all."""
    n = titles.groupBy("category").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def top_tokens(titles: DataFrame, slug: str = "other", most: int = 30) -> DataFrame:
    """The commonest tokens of a category's titles; `most` is the report's length."""
    return titles.filter(F.col("category") == slug).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)


def price_audit(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Each stored row's verdict. stored: keys, price; live: keys, live_price."""
    return stored.join(live, keys, "left").withColumn("verdict", drift(F.col("live_price"), F.col("price")))


def sample(stored: DataFrame, per_shop: int, seed: int = 0, key: str = "offer_id") -> DataFrame:
    """Some rows of each shop, the same for the same seed: those whose seed and key have the least MD5. Sampling is the feature here."""
    order = Window.partitionBy("shop_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return stored.withColumn("__rn", F.row_number().over(order)).filter(F.col("__rn") <= per_shop).drop("__rn")


def variant_price(payload: Column, variant: Column) -> Column:
    """struct(price, how) from product JSON: the variant of that id, else the first, flagged. Shares no code with the adapters."""
    found = F.from_json(F.get_json_object(payload, "$.variants"), "array<struct<id:string,price:string>>")
    own = F.get(F.filter(found, lambda v: v["id"] == variant), F.lit(0))["price"]
    head = F.get(found, F.lit(0))["price"]
    how = F.when(own.isNotNull(), "variant").when(head.isNotNull(), "first variant").otherwise("none")
    return F.struct(F.coalesce(own, head).try_cast("double").alias("price"), how.alias("how"))


def store_price(payload: Column) -> Column:
    """struct(price, how) from store-API JSON in minor units."""
    digits = F.coalesce(F.get_json_object(payload, "$.prices.currency_minor_unit").try_cast("int"), F.lit(2))
    price = F.get_json_object(payload, "$.prices.price").try_cast("double") / F.pow(F.lit(10.0), digits)
    return F.struct(price.alias("price"), F.when(price.isNotNull(), "api").otherwise("none").alias("how"))


def page_price(html: Column) -> Column:
    """struct(price, how) from a page: the first price that its JSON-LD text names, else a price element's."""
    named = F.regexp_extract(html, r'"price"\s*:\s*"?([0-9]+(?:[.,][0-9]+)?)', 1)
    shown = F.regexp_extract(html, r'class="?price"?[^>]*>\s*([0-9]+(?:[.,][0-9]+)?)', 1)
    text = F.when(named != "", named).otherwise(shown)
    how = F.when(named != "", "json-ld").when(shown != "", "element").otherwise("none")
    return F.struct(F.translate(text, ",", ".").try_cast("double").alias("price"), how.alias("how"))
