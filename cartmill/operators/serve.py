"""Ranked search, facets, per-shop best prices, summaries, history and statistics over products, offers and shops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartmill.functions.text import fold
from cartmill.vocabulary import SEARCH_WORDS

ORDERS = {
    "price": (F.asc_nulls_last, ("min_price",)),
    "unit": (F.asc_nulls_last, ("min_unit",)),
    "name": (None, ()),
    "offers": (F.desc, ("shops_in_stock", "offer_count")),
}


def per_product(offers: DataFrame) -> DataFrame:
    """min_price and min_unit over offers in stock, or over all where none is; shops in stock; offers in all."""
    live = lambda c: F.when(F.col("in_stock"), F.col(c))
    return offers.groupBy("product_id").agg(
        F.coalesce(F.min(live("price")), F.min("price")).alias("min_price"),
        F.coalesce(F.min(live("unit_price")), F.min("unit_price")).alias("min_unit"),
        F.countDistinct(live("shop_id")).alias("shops_in_stock"),
        F.count("*").alias("offer_count"),
    )


def like(column: Column, word: str) -> Column:
    """Substring match; % and _ in the word are wild, as in the system whose results are matched."""
    return column.like(f"%{word}%")


def word_filter(products: DataFrame, query: str, names: tuple[str, ...] = ("name", "brand")) -> DataFrame:
    """Products of which each of the query's first words is in one of the columns."""
    for word in query.lower().split()[:SEARCH_WORDS]:
        products = products.filter(F.greatest(*[F.coalesce(like(F.lower(F.col(n)), word), F.lit(False)) for n in names]))
    return products


def title_filter(products: DataFrame, titles: DataFrame, query: str) -> DataFrame:
    """The same, or an offer's title (product_id, title) has the word: one semi-join a word."""
    for word in query.lower().split()[:SEARCH_WORDS]:
        hit = titles.filter(like(F.lower(fold(F.col("title"))), word)).select("product_id").distinct().withColumn("__hit", F.lit(True))
        own = F.greatest(*[F.coalesce(like(F.lower(F.col(n)), word), F.lit(False)) for n in ("name", "brand")])
        products = products.join(hit, "product_id", "left").filter(own | F.coalesce("__hit", F.lit(False))).drop("__hit")
    return products


def rank(products: DataFrame, agg: DataFrame, sort: str = "price") -> DataFrame:
    found = products.join(agg, "product_id")
    if sort == "name":
        return found.orderBy(F.lower("name"), "product_id")
    how, columns = ORDERS[sort]
    return found.orderBy(*[how(c) for c in columns], "product_id")


def page(ranked: DataFrame, number: int = 1, size: int = 48) -> DataFrame:
    """One page. Sorting and limit meet in a top-k, so no full sort is made."""
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("pages start at 1 and hold 1 to 200 rows")
    return ranked.offset((number - 1) * size).limit(size)


def comparable(offers: DataFrame, in_stock: bool = False) -> DataFrame:
    """product_id of what two shops or more sell."""
    rows = offers.filter("in_stock") if in_stock else offers
    return rows.groupBy("product_id").agg(F.countDistinct("shop_id").alias("n")).filter("n > 1").select("product_id")


def facets(products: DataFrame) -> DataFrame:
    """category, subcategory (null: the whole category), n and place; `other` last, then by count."""
    rolled = products.rollup("category", "subcategory").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g < 3")
    tree = rolled.select("category", F.when(F.col("g") == 0, F.col("subcategory")).alias("subcategory"), "n", (F.col("g") == 1).alias("whole")).filter("whole or subcategory is not null")
    order = Window.partitionBy("whole", F.when(~F.col("whole"), F.col("category"))).orderBy((F.lower("category") == "other"), F.desc("n"), "category", "subcategory")
    return tree.withColumn("place", F.row_number().over(order)).select("category", "subcategory", "n", "place")


def shop_list(shops: DataFrame, offers: DataFrame) -> DataFrame:
    counts = offers.groupBy("shop_id").agg(F.count("*").alias("n"))
    return shops.join(counts, "shop_id", "left").select("shop_id", "slug", "name", "country", F.coalesce("n", F.lit(0)).alias("offer_count"))


def summary(offers: DataFrame) -> DataFrame:
    """Per product, over offers in stock or else all: prices, spread in percent, offers, shops, best unit price."""
    any_live = F.max("in_stock").over(Window.partitionBy("product_id"))
    shown = offers.withColumn("__any", any_live).filter(F.col("in_stock") | ~F.col("__any"))
    out = shown.groupBy("product_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count("*").alias("offer_count"), F.countDistinct("shop_id").alias("shops"), F.min("unit_price").alias("best_unit_price"))
    return out.withColumn("spread", F.when(F.col("min_price") > 0, F.round((F.col("max_price") - F.col("min_price")) / F.col("min_price") * 100, 1)))


def best_per_shop(offers: DataFrame, landed: Column) -> DataFrame:
    """The best offer of each product in each shop: in stock first, then by landed cost, or price where that is 0 or null."""
    cost = F.coalesce(F.nullif(landed, F.lit(0.0)), F.col("price"))
    order = Window.partitionBy("product_id", "shop_id").orderBy(F.desc("in_stock"), cost, "price", "offer_id")
    return offers.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def history(points: DataFrame) -> DataFrame:
    """One row a product and shop: its points as an array in time order."""
    return points.groupBy("product_id", "shop_id").agg(F.sort_array(F.collect_list(F.struct("observed_at", "price", "in_stock"))).alias("points"))
