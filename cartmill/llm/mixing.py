"""Mixing sources to target weights by a curriculum that changes over training time.

Each source has a target of words and a weight schedule over training time 0 to 1. The schedule's integral is
the source's cumulative demand; a document that stands at a share u of its source's demand is trained where
the integral reaches u, so inverting the integral gives its position. Copy k of a document stands k times the
source's size further on, so each copy has a position of its own. Documents are range-sorted by position.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating; they share all words; a target is
at most `max_repeats` times its source's size, and the excess is shared again by weight. That process ends at
min(cap, level * weight) with one level for all, found here in one pass over the sources sorted by cap/weight.

A source takes whole documents: all of them for each full epoch in its target, and for the rest of the target
those that come first in a hash order, up to the one whose middle passes it. So the words taken differ from
the target by half a document at most.

Cases: null text has size 0 and takes 0; a null source is a source of its own; equal rows are rows each; an
empty table gives no rows; other columns pass through `mix`, except those that it adds, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartmill.llm.blocks import block_count, running
from cartmill.llm.text import n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Slope of the schedule 1 + slope * (2t - 1) of the sources of each weight: heavy ones come early, light ones late.
SLOPES = (-0.5, 0.0, 0.5)
MAX_REPEATS = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> and rank, target. One row a source, so its windows see only as many rows."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", weight)
    ranked = ranked.withColumns({"cap": F.col("source_size") * float(max_repeats), "total": F.sum("source_size").over(all_rows).cast("double")})
    tight = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "rank")
    before, here_on = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    # the level if all sources before this one are at their caps and none from here on is
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(here_on)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max(fits).over(all_rows))  # the first that fits: later ones only fall
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")))
        .select("source", "source_size", "rank", "target")
    )


def position(u: Column, slope: Column) -> Column:
    """The time t at which the integral t + slope * (t*t - t) of the schedule reaches u."""
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * u, F.lit(0.0)))
    return F.when(slope == 0, u).otherwise((root - b) / (2 * slope))


def mix(docs: DataFrame, seed: int = 7, rows: int | None = None) -> DataFrame:
    """Adds size, source_size, target, taken, copies, position and positions.

    `positions` has one of each copy taken, in order; `position` is that of the first, also where none is taken.
    """
    named = docs.drop("size", "source_size", "target", "taken", "copies", "position", "positions", "__key", "__ahead")
    sized = named.withColumns({"size": n_words(F.col("text")), "__key": F.xxhash64(F.lit(seed), "doc_id"), "__tie": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))})
    return plan_mix(sized, docs.count() if rows is None else rows).drop("__key", "__tie", "__ahead")


def plan_mix(sized: DataFrame, rows: int) -> DataFrame:
    """The same over rows that have size, source, __key and __tie already."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes).withColumnRenamed("source", "__source")
    run = running(sized, "source", "__key", block_count(rows), "size", ["__tie", "size"], "__ahead")
    joined = run.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - epochs * F.col("source_size")
    extra = (F.col("size") > 0) & (F.col("__ahead") + F.col("size") / 2 <= rest)
    copies = F.when(F.col("size") > 0, epochs + extra.cast("int")).otherwise(F.lit(0)).cast("int")
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))
    share = lambda k: F.when(F.col("target") > 0, F.least((F.col("__ahead") + k * F.col("source_size")) / F.col("target"), F.lit(1.0))).otherwise(F.lit(1.0))
    each = F.transform(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))), lambda k: position(share(k - 1), slope))
    dealt = joined.withColumns({"copies": copies, "taken": copies * F.col("size")}).withColumn("__each", each)
    return dealt.withColumns({"position": F.get("__each", F.lit(0)), "positions": F.slice("__each", 1, F.col("copies"))}).drop("rank", "__each")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position and positions of every document, range-sorted by position."""
    sized = docs.select(
        "doc_id",
        "source",
        n_words(F.col("text")).alias("size"),
        F.xxhash64(F.lit(7), "doc_id").alias("__key"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("__tie"),
    )
    mixed = plan_mix(sized, docs.count())
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position", "positions").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
