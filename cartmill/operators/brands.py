"""Learning brands from titles: words that lead many titles, and aren't products, descriptions or shop names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartmill.functions.text import clean, fold
from cartmill.vocabulary import CROSS_SHOPS, CROSS_TITLES, FOLLOWER_FREQUENCY, HEAD_SHARE, LEARN_LENGTH, LEARN_TITLES, NOT_BRANDS, STOPWORDS, VENDOR_TITLES, Vocabulary


def plausible(token: Column, vocabulary: Vocabulary) -> Column:
    """Letters, spaces, ' and - only, three or more; neither it nor a word of it a description or known product word."""
    known = F.array(*map(F.lit, sorted({*NOT_BRANDS, *vocabulary.synonyms})))
    stop = F.array(*map(F.lit, STOPWORDS))
    words = F.split(token, " ")
    return (F.length(F.replace(token, F.lit(" "), F.lit(""))) >= LEARN_LENGTH) & ~F.array_contains(stop, token) & ~F.arrays_overlap(F.concat(words, F.array(token)), known) & token.rlike("^[a-z][a-z' -]*$")


def leads(titles: DataFrame) -> DataFrame:
    """shop_id, key (cleaned title), first, second, vendor of each title with a word."""
    words = F.filter(F.split("key", " "), lambda w: w != "")
    rows = titles.select("shop_id", clean(F.coalesce("title", F.lit(""))).alias("key"), clean(F.coalesce("vendor", F.lit(""))).alias("vendor"))
    return rows.withColumn("__w", words).filter(F.size("__w") > 0).select("shop_id", "key", F.get("__w", F.lit(0)).alias("first"), F.get("__w", F.lit(1)).alias("second"), "vendor", F.array_distinct("__w").alias("words"))


def compound_heads(rows: DataFrame) -> DataFrame:
    """first: words whose commonest follower follows more than 60 % of the time and is frequent itself, so that they name half of a product."""
    follow = rows.filter("second is not null").groupBy("first", "second").agg(F.count("*").alias("n"))
    w = Window.partitionBy("first")
    top = follow.withColumns({"total": F.sum("n").over(w), "rn": F.row_number().over(w.orderBy(F.desc("n"), "second"))}).filter("rn = 1")
    frequency = rows.select(F.explode("words").alias("second")).groupBy("second").agg(F.count("*").alias("df"))
    return top.join(frequency, "second").filter((F.col("total") >= LEARN_TITLES) & (F.col("n") > HEAD_SHARE * F.col("total")) & (F.col("df") >= FOLLOWER_FREQUENCY)).select("first")


def learn(titles: DataFrame, shops: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """brand, source (unigram, bigram, vendor or seed). titles: shop_id, title, vendor; shops: name."""
    rows = leads(titles)
    names = shops.select(F.lower(fold(F.col("name"))).alias("brand")).distinct()
    heads = compound_heads(rows)
    counted = rows.groupBy("first").agg(F.countDistinct("key").alias("titles"), F.countDistinct("shop_id").alias("shops"))
    enough = (F.col("titles") >= LEARN_TITLES) | ((F.col("shops") >= CROSS_SHOPS) & (F.col("titles") >= CROSS_TITLES))
    one = counted.filter(enough & plausible(F.col("first"), vocabulary)).join(heads, "first", "left_anti").select(F.col("first").alias("brand")).join(names, "brand", "left_anti")
    seed = titles.sparkSession.createDataFrame([(b,) for b in vocabulary.brands], "brand string")
    pairs = rows.filter("second is not null").groupBy("first", "second").agg(F.countDistinct("key").alias("titles"))
    pair = F.concat_ws(" ", "first", "second")
    tail = ~F.array_contains(F.array(*map(F.lit, sorted({*NOT_BRANDS, *vocabulary.synonyms}))), F.col("second"))
    taken = one.unionByName(seed).select(F.col("brand").alias("first")).distinct()
    two = pairs.filter((F.col("titles") >= LEARN_TITLES) & tail & plausible(pair, vocabulary)).join(heads, "first", "left_anti").join(taken, "first", "left_anti").select(pair.alias("brand")).join(names, "brand", "left_anti")
    made = rows.filter("vendor <> ''").groupBy("vendor").agg(F.countDistinct("key").alias("titles")).filter((F.col("titles") >= VENDOR_TITLES) & plausible(F.col("vendor"), vocabulary)).select(F.col("vendor").alias("brand")).join(names, "brand", "left_anti")
    every = one.withColumn("source", F.lit("unigram")).unionByName(two.withColumn("source", F.lit("bigram"))).unionByName(made.withColumn("source", F.lit("vendor"))).unionByName(seed.join(names, "brand", "left_anti").withColumn("source", F.lit("seed")))
    return every.groupBy("brand").agg(F.max("source").alias("source"))
