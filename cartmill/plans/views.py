"""The engine's tables as views over the given star schema: shops, products, offers, observations, titles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartmill.functions import text
from cartmill.vocabulary import BRANDS, Vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place that driver and executors share; a local one only where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or "file:///tmp/cartmill-checkpoints"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once and read again: for what several branches of a plan need and is dear to make."""
    place = folder(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shop_id, slug, name, country"""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("shop_id"), F.lower("s_name").alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("country"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, name, brand, category, subcategory, size_value (kg)"""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.when(F.col("p_size") <= 16, "small").when(F.col("p_size") <= 33, "medium").otherwise("large").alias("subcategory"),
        F.col("p_size").cast("double").alias("size_value"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, shop_id, price, in_stock, observed_at and what breaks ties: every line is one look at an offer."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("shop_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
        F.col("l_shipdate").alias("observed_at"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
    )


def latest(seen: DataFrame) -> DataFrame:
    """The last observation of each offer."""
    order = Window.partitionBy("product_id", "shop_id").orderBy(F.desc("observed_at"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "in_stock")
    return seen.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("product_id", "shop_id", "price", "in_stock", "observed_at")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, shop_id, price, in_stock, observed_at, weight_grams, base_value (kg), unit_price"""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_size") * 100).alias("weight_grams"), F.col("p_size").cast("double").alias("base_value"))
    return latest(observations(spark, sf_dir)).join(sizes, "product_id").withColumn("unit_price", F.when(F.col("base_value") > 0, F.col("price") / F.col("base_value")))


#: The titles' makers beside the usual brands.
TITLE_BRANDS = tuple(f"brand{i}" for i in range(1, 26))
TITLE_VOCABULARY = Vocabulary(brands=(*BRANDS, *TITLE_BRANDS))


def raw_titles(spark: SparkSession, sf_dir: str, deal: bool = True) -> DataFrame:
    """offer_id, shop_id, title, vendor: the maker first, last or only as vendor; sizes plain, as packs, or with a count apart; accents and synonyms.

    `deal`: a small table's rows go to all cores.
    """
    maker, size, key = F.translate("p_brand", "#", ""), F.col("p_size").cast("string"), F.col("p_partkey")
    said = F.when(key % 3 == 1, F.lit(None)).otherwise(maker)  # else the vendor alone tells
    title = (
        F.when(key % 5 == 0, F.concat_ws(" ", "p_name", said, F.concat(size, F.lit("kg"))))
        .when(key % 5 == 1, F.concat_ws(" ", said, "p_name", F.concat(F.lit("3 x "), size, F.lit("kg"))))
        .when(key % 5 == 2, F.concat_ws(" ", F.lit("Ryż"), "p_name", F.lit("– ½"), said, F.concat(size, F.lit(" KG"))))
        .when(key % 5 == 3, F.concat_ws(" ", "p_name", said, F.concat(size, F.lit("kg, Pack of 4"))))
        .otherwise(F.concat_ws(" ", F.lit("Premium"), "p_name", F.concat(size, F.lit("00g x 2")), said, F.lit("spices")))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    cores = spark.sparkContext.defaultParallelism
    if deal and part.rdd.getNumPartitions() < cores:  # parsing titles is dear, and a small file would be one task
        part = part.repartition(cores)
    return part.select(key.alias("offer_id"), (key % 7).alias("shop_id"), title.alias("title"), F.when(key % 3 != 0, maker).alias("vendor"))


def titles(spark: SparkSession, sf_dir: str, vocabulary: Vocabulary = TITLE_VOCABULARY) -> DataFrame:
    """offer_id, shop_id, title, vendor, brand, tokens, size, tag"""
    return parse_titles(raw_titles(spark, sf_dir), vocabulary)


def title_texts(spark: SparkSession, sf_dir: str, members: bool = False, vocabulary: Vocabulary = TITLE_VOCABULARY) -> DataFrame:
    """brand, tokens, tag, n (titles), offer_ids (if `members`) of each distinct title and vendor: equal ones are parsed once, and written.

    Written, because a filter or an explode on tokens would be pushed below the parsing, and repeat it with each use.
    """
    found = [F.count("*").alias("n"), *([F.collect_list("offer_id").alias("offer_ids")] if members else [])]
    texts = raw_titles(spark, sf_dir, deal=False).groupBy("title", "vendor").agg(*found)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = parse_titles(texts.repartition(parts), vocabulary)
    return kept(parsed.select("brand", "tokens", "tag", "n", *(["offer_ids"] if members else [])), "texts")


def parse_titles(raw: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds brand, tokens, size and tag to rows with title and vendor."""
    # each step a column of its own: expressions that use one several times would repeat all that it is made of
    step = raw.withColumns({"__folded": F.lower(text.fold(F.col("title"))), "__maker": text.clean(F.coalesce("vendor", F.lit("")))}).withColumn("__clean", text.clean_folded(F.col("__folded")))
    step = step.withColumns({"brand": text.brand_of(F.col("__clean"), F.col("__maker"), vocabulary.brands), "__said": F.coalesce("__folded", F.lit(""))})
    step = step.withColumns({"tokens": text.tokens(F.col("__clean"), F.col("brand"), vocabulary), "size": text.parse_folded_size(F.col("__said"))})
    return step.withColumn("tag", text.size_tag(F.col("size.base_value"), F.col("size.base_unit"))).drop("__folded", "__maker", "__clean", "__said")
