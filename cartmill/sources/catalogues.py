"""Shop catalogues as landed files: product JSON with variants, store-API JSON, shop registry."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartmill.functions.numbers import grams, lenient_float, minor_units
from cartmill.operators.shipping import RULES

OFFER = ("external_id", "title", "url", "price", "currency", "in_stock", "image_url", "sku", "brand", "compare_at_price", "weight_grams", "raw_vendor")

VARIANT = "struct<id:string,title:string,price:string,compare_at_price:string,available:boolean,sku:string,grams:int,featured_image:struct<src:string>>"
PRODUCT = f"id string, title string, handle string, vendor string, images array<struct<src:string>>, variants array<{VARIANT}>"

PRICES = "struct<price:string,regular_price:string,currency_code:string,currency_minor_unit:int>"
STORE_PRODUCT = f"id string, name string, permalink string, sku string, is_in_stock boolean, weight string, prices {PRICES}, images array<struct<src:string>>, brands array<struct<name:string>>, categories array<struct<name:string>>"


def unescape(text: Column) -> Column:
    """HTML entities to characters; no built-in does that."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else html.unescape(x))

    return run(text)


def variants(products: DataFrame, base_url: str, currency: str) -> DataFrame:
    """One offer a variant of product JSON rows. A default title adds nothing; rows without a price go."""
    v = products.select("id", "title", "handle", "vendor", "images", F.explode("variants").alias("v"))
    plain = F.lower(F.coalesce(F.trim("v.title"), F.lit(""))).isin("default title", "")
    out = v.select(
        F.col("v.id").alias("external_id"),
        F.when(plain, F.trim("title")).otherwise(F.concat_ws(" ", F.trim("title"), F.trim("v.title"))).alias("title"),
        F.concat(F.lit(f"{base_url}/products/"), "handle").alias("url"),
        lenient_float(F.col("v.price")).alias("price"),
        F.lit(currency).alias("currency"),
        F.coalesce("v.available", F.lit(True)).alias("in_stock"),
        F.coalesce("v.featured_image.src", F.get("images", F.lit(0))["src"]).alias("image_url"),
        F.col("v.sku").alias("sku"),
        F.col("vendor").alias("brand"),
        lenient_float(F.col("v.compare_at_price")).alias("compare_at_price"),
        F.nullif(F.col("v.grams"), F.lit(0)).alias("weight_grams"),
        F.col("vendor").alias("raw_vendor"),
    )
    return out.filter("price is not null")


def store_products(products: DataFrame, currency: str, weight_unit: str = "g") -> DataFrame:
    """One offer a store-API row: prices in minor units, entities unescaped, weight in the shop's unit."""
    p = F.col("prices")
    regular, price = minor_units(p["regular_price"], p["currency_minor_unit"]), minor_units(p["price"], p["currency_minor_unit"])
    out = products.select(
        F.col("id").alias("external_id"),
        unescape(F.col("name")).alias("title"),
        F.col("permalink").alias("url"),
        price.alias("price"),
        F.coalesce(p["currency_code"], F.lit(currency)).alias("currency"),
        F.coalesce("is_in_stock", F.lit(True)).alias("in_stock"),
        F.get("images", F.lit(0))["src"].alias("image_url"),
        F.nullif(F.col("sku"), F.lit("")).alias("sku"),
        unescape(F.get("brands", F.lit(0))["name"]).alias("brand"),
        F.when(regular > price, regular).alias("compare_at_price"),
        grams(F.col("weight"), F.lit(weight_unit)).alias("weight_grams"),
        F.lit(None).cast("string").alias("raw_vendor"),
    )
    return out.filter("price is not null")


def read_pages(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Landed JSON pages under a path, with a fixed schema; unreadable records become nulls."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


SHOP_DDL = f"slug string, name string, url string, platform string, country string, currency string, ships_to array<string>, active boolean, weight_unit string, shipping_rules {RULES}"


def read_registry(path: str) -> list[dict]:
    """The entries of a registry file: YAML where a reader for it is installed, else JSON; a list, or a list under `shops`."""
    import json
    from pathlib import Path

    body = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        found = json.loads(body)
    else:
        found = yaml.safe_load(body)
    return found["shops"] if isinstance(found, dict) else found


def load_shops(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """The registry's entries as shops, with defaults: country PL, currency PLN, ships at home, active, grams."""
    rows = [
        {
            "slug": e["slug"],
            "name": e.get("name", e["slug"]),
            "url": e.get("url"),
            "platform": e.get("platform"),
            "country": e.get("country", "PL"),
            "currency": e.get("currency", "PLN"),
            "ships_to": e.get("ships_to") or [e.get("country", "PL")],
            "active": e.get("active", True),
            "weight_unit": e.get("weight_unit", "g"),
            "shipping_rules": e.get("shipping_rules"),
        }
        for e in entries
    ]
    return spark.createDataFrame(rows, SHOP_DDL)


def upsert_shops(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries replace shops of their slug; other shops stay."""
    return stored.join(entries.select("slug"), "slug", "left_anti").unionByName(entries)


#: What reads each platform's landed data.
ADAPTERS = {"shopify": variants, "woocommerce": store_products}


def adapter_for(platform: str):
    if platform not in (*ADAPTERS, "html"):
        raise ValueError(f"no adapter for platform {platform!r}")
    return ADAPTERS.get(platform)
