"""Upsert, delisting, change-only history, placeholder prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartmill.vocabulary import PLACEHOLDER_COUNT, PLACEHOLDER_MOST, PLACEHOLDER_SHARE, PRICE_EPSILON

KEYS = ("shop_id", "external_id")


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter((F.length(F.coalesce("title", F.lit(""))) > 0) & (F.col("price") > 0))


def placeholder_prices(rows: DataFrame) -> DataFrame:
    """shop_id, price of prices up to 2.00 that a shop repeats 5 times and on a twentieth of its rows."""
    totals = rows.groupBy("shop_id").agg(F.count("*").alias("all"))
    low = rows.filter(F.col("price") <= PLACEHOLDER_MOST).groupBy("shop_id", "price").agg(F.count("*").alias("n"))
    return low.join(totals, "shop_id").filter(F.col("n") >= F.greatest(F.lit(PLACEHOLDER_COUNT), F.floor(F.col("all") * PLACEHOLDER_SHARE))).select("shop_id", "price", "n")


def without_placeholders(rows: DataFrame) -> DataFrame:
    return rows.join(placeholder_prices(rows).select("shop_id", "price"), ["shop_id", "price"], "left_anti")


def changed(price: Column, stock: Column, old_price: Column, old_stock: Column) -> Column:
    return old_price.isNull() | (F.abs(price - old_price) > PRICE_EPSILON) | (stock != old_stock)


def upsert(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Stored and incoming rows (keys, title, price, in_stock) as one table with a status: created, updated, same or delisted.

    Of rows with equal keys in one fetch the cheapest stays, by title. A stored row that no incoming one names
    stays, out of stock; status `gone` if it was so already.
    """
    once = Window.partitionBy(*keys).orderBy("price", "title")
    new = incoming.withColumn("__rn", F.row_number().over(once)).filter("__rn = 1").drop("__rn")
    a = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("title", "price", "in_stock")]).withColumn("__old", F.lit(True))
    both = a.join(new.withColumn("__new", F.lit(True)), list(keys), "full_outer")
    is_new, was = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    status = F.when(is_new & ~was, "created").when(is_new & changed(F.col("price"), F.col("in_stock"), F.col("old_price"), F.col("old_in_stock")), "updated").when(is_new, "same").when(F.col("old_in_stock"), "delisted").otherwise("gone")
    return both.select(*keys, F.coalesce("title", "old_title").alias("title"), F.coalesce("price", "old_price").alias("price"), F.when(is_new, F.col("in_stock")).otherwise(F.lit(False)).alias("in_stock"), status.alias("status"))


def counters(upserted: DataFrame) -> DataFrame:
    """One row: how many offers were fetched, created, changed, delisted."""
    return upserted.agg(
        F.count_if(F.col("status").isin("created", "updated", "same")).alias("fetched"),
        F.count_if(F.col("status") == "created").alias("created"),
        F.count_if(F.col("status").isin("updated", "same")).alias("updated"),
        F.count_if(F.col("status") == "updated").alias("price_changes"),
        F.count_if(F.col("status") == "delisted").alias("delisted"),
    )


def changes(seen: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of observations in order, the first of each offer and those whose price or stock differs from the last."""
    w = Window.partitionBy(*keys).orderBy(*order)
    old = seen.withColumns({"__price": F.lag("price").over(w), "__stock": F.lag("in_stock").over(w)})
    return old.filter(changed(F.col("price"), F.col("in_stock"), F.col("__price"), F.col("__stock"))).drop("__price", "__stock")


def status(shop: Column, counts: Column) -> Column:
    """A shop's status line of up to 255 characters, from a struct of counters."""
    line = F.format_string("ok: %d fetched, %d new, %d price changes, %d delisted", counts["fetched"], counts["created"], counts["price_changes"], counts["delisted"])
    return F.substring(F.coalesce(line, F.concat(F.lit("failed: "), shop)), 1, 255)


def counters_by_shop(upserted: DataFrame) -> DataFrame:
    """shop_id, counters and status of each shop; one shop's rows never touch another's."""
    is_ = lambda *names: F.count_if(F.col("status").isin(*names))
    counted = upserted.groupBy("shop_id").agg(is_("created", "updated", "same").alias("fetched"), is_("created").alias("created"), is_("updated").alias("price_changes"), is_("delisted").alias("delisted"))
    return counted.withColumn("status", status(F.col("shop_id").cast("string"), F.struct("fetched", "created", "price_changes", "delisted")))
