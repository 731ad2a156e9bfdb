"""Numbering and running sums over groups of any size.

A window over one group is one task, however large the group. Here a group is cut into blocks by a hash of
its order key; a window runs inside each block, and the blocks' totals (one small row a block) are summed
up in their own window and joined back. Blocks grow in number with the rows, so a task's share stays level.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 20_000


def block_count(rows: int, rows_per_block: int = ROWS_PER_BLOCK) -> int:
    """Blocks for that many rows; a power of two, at least 1."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / rows_per_block)))


def hash_block(key: Column, blocks: int) -> Column:
    """The block of a 64-bit key: its highest bits as an unsigned number, so that blocks follow key order."""
    bits = int(math.log2(blocks))
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def running(df: DataFrame, group: str, key: str, blocks: int, value: str, ties: list[str], out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the group's rows before this one, in the order of `key`'s unsigned bits.

    `key` is a 64-bit hash, `ties` break equal keys. Null groups form a group. A null value counts as 0.
    """
    blocked = df.withColumn("__block", hash_block(F.col(key), blocks))
    totals = blocked.groupBy(group, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col(group).alias("__g"),
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"),
    )
    inside = (
        Window.partitionBy(group, "__block")
        .orderBy(F.col(key).bitwiseXOR(F.lit(-(2**63))), *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = blocked.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b"))
    return (
        rows.join(totals, same, "left")
        .withColumn(out, F.coalesce(F.col("__before"), F.lit(0)) + F.col("__inside"))
        .drop("__g", "__b", "__block", "__before", "__inside")
    )
