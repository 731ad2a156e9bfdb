"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits in lower case; a shingle is five of them, known by a 64-bit hash; a text of
fewer words is one shingle, its whole sequence. A window and an item are bags of shingles, each weighing as often as
it occurs; their similarity is the sum of lesser weights over the sum of greater ones. A document is contaminated by
an item if a window of the item's size, or what of it lies inside the document, has similarity 0.8 or more.

1. Anchors: places of a document whose shingle some item has. A window without one has similarity 0. An anchor
   that is an item's shingle number o aligns a window of that item's size.
2. Each distinct window gets a 64-bit SimHash of its shingles by weight.
3. Multi-index search: fingerprints are cut into BLOCKS blocks. Two within RADIUS bits differ in at most
   RADIUS // BLOCKS bits of one block at least. So each item is entered under all values that near to its own, block
   by block, each window under its own value, and an equality join on item size, block and value finds every pair within
   RADIUS, while a random pair of one size meets with a chance of about a half. Windows of similarity 0.8 differ in
   12 bits at most on average, with a deviation of about 3: RADIUS leaves nearly four deviations (README has what
   is measured).
4. Candidates are verified exactly.

All steps are DataFrame expressions. What is broadcast (the items' shingles, the anchored documents' keys, the items'
index) is counted first; beyond BROADCAST_ROWS the same joins shuffle. Documents are known by two 64-bit hashes.

Cases: null and blank texts match nothing; texts and items of fewer than five words match only what has the same
words. A document that repeats is in the report each time. Empty tables give no rows. Documents may have any other
columns; `clean` keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartmill.llm.text import scratch

SHINGLE, PERCENT, RADIUS, BLOCKS = 5, 80, 24, 5
KEYS = ["__key", "__key2"]
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column) -> Column:
    """A hash of each window of five words, in text order; of all words where there are fewer; null without words."""
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    few = F.when(bare != "", F.array(F.xxhash64(F.lit(SHINGLE), bare)))
    return F.coalesce(window_hashes(F.split(bare, " ")), few)


def window_hashes(ws: Column, size: int = SHINGLE) -> Column:
    """Hashes of all windows of an array of words; null where it has fewer."""
    one = F.transform(F.array(ws), lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))))
    return F.element_at(one, 1)


def simhash(hashes: Column) -> Column:
    """Each bit is that of the greater part of the hashes, ties 0. Two bits a sum, 32 bits apart."""
    total, lane = F.size(hashes), (1 << 32) + 1
    out = F.lit(0).cast("long")

    def add(k: int):
        return lambda s, h: s + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(lane).cast("long"))

    for k in range(32):
        both = F.aggregate(hashes, F.lit(0).cast("long"), add(k))
        low, high = both.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(both, 32)
        for count, at in ((low, k), (high, k + 32)):
            bit = (1 << at) - (1 << 64 if at == 63 else 0)
            out = out.bitwiseOR(F.when(2 * count > total, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def blocks(fingerprint: Column, near: int = 0, n: int = BLOCKS) -> Column:
    """(block, value) of each of n blocks of the 64 bits, as even as can be; with `near`, all values within that many bits."""
    out = []
    for i in range(n):
        low, high = 64 * i // n, 64 * (i + 1) // n
        value = F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))
        flips = F.filter(F.sequence(F.lit(0).cast("long"), F.lit((1 << (high - low)) - 1).cast("long")), lambda m: F.bit_count(m) <= near) if near else F.array(F.lit(0).cast("long"))
        out.append(F.transform(flips, _entry(i, value)))
    return F.flatten(F.array(*out))


def _entry(i: int, value: Column):
    return lambda m: F.struct(F.lit(i).alias("block"), value.bitwiseXOR(m).alias("value"))


def common_weight(x: Column, y: Column) -> Column:
    """Of two bags, the sum of lesser weights. Bags without repeats need no counting."""
    both = F.array_intersect(x, y)
    plain = (F.size(F.array_distinct(x)) == F.size(x)) | (F.size(F.array_distinct(y)) == F.size(y))
    count = lambda bag, h: F.size(F.filter(bag, lambda v: v == h))
    counted = F.aggregate(both, F.lit(0), lambda s, h: s + F.least(count(x, h), count(y, h)))
    return F.when(plain, F.size(both)).otherwise(counted)


def _checked(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_keys() -> dict[str, Column]:
    """Two hashes of doc_id and text; hashes skip nulls, so where they are counts too."""
    given = [F.col("doc_id"), F.col("text"), F.col("doc_id").isNull(), F.col("text").isNull()]
    return {"__key": F.xxhash64(*given), "__key2": F.xxhash64(F.lit(2), *given)}


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """__key, __key2, item_id, similarity, first_word (from 0): one row a distinct document and item, the best window's."""
    spark = docs.sparkSession
    folder = scratch(spark, "decontam")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    bags = kept(items.select("item_id", shingle_hashes(F.col("text")).alias("bag")).filter("bag is not null").withColumns({"size": F.size("bag"), "item_hash": simhash(F.col("bag"))}), "items")
    known = bags.select("size", F.posexplode("bag").alias("o", "h")).distinct()
    n_known = known.count()
    given = docs.select("doc_id", "text")
    spots = given.select(*[c.alias(k) for k, c in row_keys().items()], F.posexplode(shingle_hashes(F.col("text"))).alias("p", "h"))
    anchors = spots.join(_checked(known, n_known), "h")
    aligned = kept(anchors.select(*KEYS, (F.col("p") - F.col("o")).alias("at"), "size").distinct(), "windows")
    keys = aligned.select(*KEYS).distinct()
    n_keys = keys.count()
    near = given.withColumns(row_keys()).select(*KEYS, "text").join(_checked(keys, n_keys), KEYS, "left_semi")
    near = near.dropDuplicates(KEYS).select(*KEYS, shingle_hashes(F.col("text")).alias("all"))
    first = F.greatest("at", F.lit(0))
    last = F.least(F.col("at") + F.col("size"), F.size("all"))
    windows = near.join(aligned, KEYS).filter(last > first).select(*KEYS, "size", first.alias("first_word"), F.slice("all", first + 1, last - first).alias("window"))
    printed = kept(windows.withColumn("window_hash", simhash(F.col("window"))), "printed")
    blocked = printed.select(*KEYS, "size", "first_word", "window_hash", F.inline(blocks(F.col("window_hash"))))
    index = kept(bags.select("item_id", "size", "item_hash", F.inline(blocks(F.col("item_hash"), RADIUS // BLOCKS))), "index")
    close = F.bit_count(F.col("window_hash").bitwiseXOR(F.col("item_hash"))) <= RADIUS
    same = (F.col("w.size") == F.col("i.size")) & (F.col("w.block") == F.col("i.block")) & (F.col("w.value") == F.col("i.value"))
    found = blocked.alias("w").join(_checked(index, index.count()).alias("i"), same & close)
    found = found.select(*KEYS, "first_word", F.col("w.size").alias("size"), "item_id").distinct()
    pairs = found.join(printed.select(*KEYS, "first_word", "size", "window"), [*KEYS, "first_word", "size"]).join(_checked(bags.select("item_id", "bag"), n_known), "item_id")
    pairs = pairs.withColumn("both", common_weight(F.col("window"), F.col("bag"))).withColumn("all", F.size("window") + F.size("bag") - F.col("both"))
    true = pairs.filter(100 * F.col("both") >= PERCENT * F.col("all"))
    best = F.max(F.struct((F.col("both") / F.col("all")).alias("similarity"), (-F.col("first_word")).alias("minus")))
    return true.groupBy(*KEYS, "item_id").agg(best.alias("best")).select(*KEYS, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.minus")).alias("first_word"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Texts are not shuffled unless what goes is too much to broadcast."""
    folder = scratch(docs.sparkSession, "decontam-bad")
    matches(docs, items).select(F.col("__key").alias("__bad"), F.col("__key2").alias("__bad2")).distinct().write.parquet(folder)
    bad, own = docs.sparkSession.read.parquet(folder), row_keys()
    return docs.join(_checked(bad, bad.count()), (own["__key"] == F.col("__bad")) & (own["__key2"] == F.col("__bad2")), "left_anti")


def match_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity and first_word of every document and item that match; equal documents are each in it."""
    keyed = docs.select("doc_id", *[c.alias(k) for k, c in row_keys().items()])
    return keyed.join(matches(docs, items), KEYS).select("doc_id", "item_id", "similarity", "first_word")
