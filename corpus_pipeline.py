"""From raw documents to training shards: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet to the shared
folder and reads again for the next; then it deletes what the stage read and what it wrote on the way. All but the last return the columns of documents.

- language: documents without a language (no letter), or whose language the model doubts, go
- near_duplicates: of each group of documents linked by shingle similarity, one row stays, that with the least doc_id (null last); of equal rows, one
- decontaminate: documents with a passage of a benchmark item go
- mix: each source's documents are taken as often as its target asks (not at all, or up to three times), in training order
- shards: each row gets its shard and its slot there

Stages read only the columns that they name; rows with null in others pass. An empty table gives empty stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartmill.llm import decontam, langid, mixing, ngram_join, sharding
from cartmill.llm.text import delete, scratch_of, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.5
SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    given = docs.select(*COLUMNS)
    model = langid.train(given, langid.default_path())
    return langid.identify(given, model).filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= SURE)).select(*COLUMNS)


def row_key() -> Column:
    """Two hashes of all columns, 128 bits: equal rows have the same. Hashes skip nulls, so where they are counts too."""
    given = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    return F.concat(F.hex(F.xxhash64(*given)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *given)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decides row by row, whatever the doc_ids are. A row with an empty set is linked with none and stays."""
    given = docs.select(*COLUMNS).withColumn("__row", row_key())
    # joined by row keys, a component is named by its least key
    found = ngram_join.join(given, "__row").select(F.col("doc_id").alias("__row"), "component_id").distinct()
    ids = given.select("__row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row"))
    stays = ids.join(found, "__row").groupBy("component_id").agg(first.alias("first")).select(F.col("first.__row").alias("__row"))
    return given.dropDuplicates(["__row"]).join(stays, "__row").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, range-sorted by training position; each copy stands at its own."""
    given = docs.select(*COLUMNS).withColumn("__row", row_key())
    # the plan is made without texts; they are dealt once to join it, and once into order
    plan = mixing.mix(given.select("__row", "doc_id", "text", "source"), rows=docs.count()).select("__row", F.explode("positions").alias("__at"))
    # of equal rows, which nothing tells apart, one stands for all that they take
    copies = given.dropDuplicates(["__row"]).join(plan, "__row")
    return copies.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id").select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and shard, grown_shard and slot."""
    given = docs.select(*COLUMNS)
    text = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return sharding.assign_shards(given, "doc_id", SHARDS, [text, F.col("n_chars")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shards", shards),
]

#: SQL can express neither the language model nor the hashes; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with scratch_of(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            delete(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
