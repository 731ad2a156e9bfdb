"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A document's shard follows from its stable key and the number of shards alone; there is no ring table. When
one shard is appended, only the rows that it takes move: every other row keeps its shard.

Cases: a null key hashes like any one key, so all null keys share a shard. Null text counts as empty. Rows
that repeat are sharded each and get slots of their own. An empty table gives no rows. Other columns pass
through `assign_shards`, whatever their names, except those that it adds, which it replaces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartmill.llm.blocks import block_count, running

#: Fixed values of the published algorithm.
JUMP_STEP, JUMP_SHIFT, JUMP_SPAN = np.uint64(2862933555777941757), np.uint64(33), float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key. All keys jump together; those that jump past the end drop out."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    out = np.zeros(len(keys), np.int64)
    left, key, at = np.arange(len(keys)), keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    while len(left):
        out[left] = at
        with np.errstate(over="ignore"):
            key = key * JUMP_STEP + np.uint64(1)
        at = ((at + 1) * (JUMP_SPAN / ((key >> JUMP_SHIFT).astype(np.float64) + 1.0))).astype(np.int64)
        on = at < shards
        left, key, at = left[on], key[on], at[on]
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key column, by Arrow batches of that one column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return jump(key)


def stable_key(column: Column) -> Column:
    """A 64-bit key from the text form of a column."""
    return F.xxhash64(column.cast("string"))


def assign_shards(df: DataFrame, key: str, shards: int, ties: list[Column], rows: int | None = None) -> DataFrame:
    """Adds shard, grown_shard (with one shard more) and slot, gapless from 0 in each shard.

    Slots follow the key's hash, then `ties`. `rows` is the number of rows, counted here if not given. Slots
    are numbered in blocks, so neither a shard nor a key that repeats makes one task grow with the input but
    for equal keys themselves.
    """
    blocks = block_count(df.count() if rows is None else rows)
    named = df.drop("shard", "grown_shard", "slot", "__key", "__one")
    keyed = named.withColumn("__key", stable_key(F.col(key)))
    keyed = keyed.withColumns({"shard": shard_of(F.col("__key"), shards), "grown_shard": shard_of(F.col("__key"), shards + 1)})
    # the key's low bits place the slot, so that blocks are independent of the shard
    mixed = keyed.withColumns({"__key": F.xxhash64("__key"), "__one": F.lit(1).cast("long")})
    names = [f"__tie{i}" for i in range(len(ties))]
    mixed = mixed.withColumns(dict(zip(names, ties, strict=True)))
    return running(mixed, "shard", "__key", blocks, "__one", names, "slot").drop("__key", "__one", *names)


def shard_report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign_shards(sized, "doc_id", shards, [F.col("text_crc32"), F.col("size")], docs.count())
