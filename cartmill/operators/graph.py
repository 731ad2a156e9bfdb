"""Connected components of a graph that may be as large as the data: large-star and small-star rounds in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root: the least node that each node of an edge reaches. Each round is written under `folder`, which cuts its lineage.

    Large stars tie each node's larger neighbours to its least one, small stars its smaller ones; the
    links end as one star a component (Kiveris et al., 2014). Minima are aggregated and joined back, so a node
    with many links makes no large row.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame, i: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/round-{i}")
        return spark.read.parquet(f"{folder}/round-{i}")

    def stars(links: DataFrame, large: bool) -> DataFrame:
        # links: a > b
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        tied = both.join(least, "a")
        if large:
            return tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        mine = tied.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return mine.unionByName(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()

    def mark(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    at = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), 0)
    was, i = mark(at), 0
    while was[0]:
        i += 1
        at = kept(stars(stars(at, True), False), i)
        if (now := mark(at)) == was:
            break
        was = now
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
