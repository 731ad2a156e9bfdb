"""The cheapest way to split a basket over shops: exact over all subsets of up to 16 shops, dropping shops one by one beyond.

In a subset each product takes its cheapest offer there; a subset that lacks one is out. A plan costs goods and each shop's
delivery. Of equal plans the one of fewest shops wins, then of the lowest shop ids. Prices are in PLN; where offers or shops
have a `currency`, prices are converted, and a shop's thresholds and fees count in its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartmill.functions.numbers import to_pln
from cartmill.operators.shipping import eta_label, item_grams, quote, to_free
from cartmill.vocabulary import EXACT_SHOPS, FX_TO_PLN


def quantities(items: DataFrame) -> DataFrame:
    """product_id, quantity: items of the same product as one, one at least."""
    return items.groupBy("product_id").agg(F.greatest(F.sum("quantity"), F.lit(1)).alias("quantity"))


def candidates(offers: DataFrame, wanted: DataFrame, shops: DataFrame, country: str | None = None) -> DataFrame:
    """The cheapest offer in stock of each wanted product (product_id, quantity) in each shop that is active and delivers to the country, if one is given."""
    open_shops = shops.filter("active")
    if country:
        open_shops = open_shops.filter(F.array_contains("ships_to", country))
    rates = F.create_map(*[F.lit(x) for pair in FX_TO_PLN.items() for x in pair])
    rate = F.coalesce(F.try_element_at(rates, F.upper("currency")), F.lit(1.0)) if "currency" in shops.columns else F.lit(1.0)
    rows = offers.filter("in_stock").join(F.broadcast(wanted), "product_id")
    if "currency" in offers.columns:
        rows = rows.withColumn("price", to_pln(F.col("price"), F.col("currency")))
    cheapest = rows.groupBy("product_id", "shop_id").agg(F.min_by(F.struct("price", "quantity", "weight_grams"), F.struct("price", "offer_id")).alias("o")).select("product_id", "shop_id", "o.*")
    return cheapest.join(open_shops.select("shop_id", "rules", rate.alias("rate")), "shop_id").select("product_id", "shop_id", "price", "quantity", "weight_grams", "rules", "rate")


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.join(found, "product_id", "left_anti").select("product_id", "quantity")


def parcels(picks: DataFrame, group: str) -> DataFrame:
    """One row a plan and shop: products, goods, grams, delivery and what goes with it. Picks are rows (group, product_id, shop_id, price, quantity, weight_grams, rules)."""
    rate = F.col("rate") if "rate" in picks.columns else F.lit(1.0)
    rows = picks.withColumn("rate", rate).groupBy(group, "shop_id").agg(
        F.sum((F.col("price") * F.col("quantity")).cast("decimal(28,10)")).cast("double").alias("goods"),
        F.sum(item_grams(F.col("weight_grams"), F.col("quantity"))).alias("grams"),
        F.first("rules").alias("rules"),
        F.first("rate").alias("rate"),
        F.array_sort(F.collect_list("product_id")).alias("products"),
    )
    own = F.col("goods") / F.col("rate")
    quoted = rows.withColumn("q", quote(F.col("rules"), own, F.col("grams"))).withColumn("gap", F.round(to_free(F.col("rules"), own) * F.col("rate"), 2))
    return quoted.withColumn("shipping", F.round(F.coalesce(F.col("q.cost") * F.col("rate"), F.lit(0.0)), 2))


def cost_of(picks: DataFrame, group: str) -> DataFrame:
    """group, cost, number of items and shops of plans given as picks."""
    return parcels(picks, group).groupBy(group).agg(
        F.round(F.sum((F.col("goods") + F.col("shipping")).cast("decimal(28,10)")), 2).cast("double").alias("cost"), F.sum(F.size("products")).alias("items"), F.array_sort(F.collect_list("shop_id")).alias("shops")
    )


def cheapest(found: DataFrame, *group: str) -> DataFrame:
    """Each product's cheapest candidate, the lowest shop id of equals."""
    facts = [c for c in found.columns if c not in ("product_id", *group)]
    return found.groupBy(*group, "product_id").agg(F.min_by(F.struct(*facts), F.struct("price", "shop_id")).alias("o")).select(*group, "product_id", "o.*")


def subsets(found: DataFrame) -> DataFrame:
    """The candidates of every subset of their shops that has all products: mask, and each product's cheapest offer there.

    At most 2**16 - 1 masks; offers meet those that contain their shop. Sizes are checked by the caller.
    """
    numbered = found.select("shop_id").distinct().withColumn("bit", F.row_number().over(Window.orderBy("shop_id")) - 1)
    n = numbered.count()
    if n > EXACT_SHOPS:
        raise ValueError(f"{n} shops: use drop_one")
    k = found.select("product_id").distinct().count()
    masks = found.sparkSession.range(1, 1 << n).select(F.col("id").alias("mask"))
    placed = found.join(F.broadcast(numbered), "shop_id")
    inside = F.broadcast(placed).join(masks, F.expr("(mask div cast(pow(2, bit) as bigint)) % 2 = 1"))
    picks = cheapest(inside, "mask")
    whole = picks.groupBy("mask").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("mask")
    return picks.join(whole, "mask")


def optimal(found: DataFrame) -> DataFrame:
    """One row: cost and the shops used, over all subsets."""
    plans = cost_of(subsets(found), "mask").withColumn("bits", F.bit_count("mask"))
    return plans.orderBy("cost", F.size("shops"), "bits", "shops", "mask").limit(1).select("cost", F.array_join(F.transform("shops", lambda s: s.cast("string")), ",").alias("shops"))


def single_shop(found: DataFrame) -> DataFrame:
    """The cheapest shop that has all products alone."""
    k = found.select("product_id").distinct().count()
    full = found.groupBy("shop_id").agg(F.count("*").alias("n")).filter(F.col("n") == k).select("shop_id")
    plans = cost_of(found.join(full, "shop_id").withColumn("plan", F.col("shop_id")), "plan")
    return plans.orderBy("cost", "plan").limit(1).select("cost", F.col("plan").cast("string").alias("shops"))


def naive(found: DataFrame) -> DataFrame:
    """Each product at its cheapest, whatever delivery costs."""
    return cost_of(cheapest(found).withColumn("plan", F.lit(0)), "plan").select("cost", F.array_join(F.transform("shops", lambda s: s.cast("string")), ",").alias("shops"))


def drop_one(found: DataFrame) -> DataFrame:
    """Beyond 16 shops: from all, drop the first shop (by id) whose loss makes the plan cheaper, until none does. Only plans reach the driver.

    The loss of a shop that the plan doesn't use changes nothing, so only those that it uses are tried.
    """
    k = found.select("product_id").distinct().count()

    def plan(gone: list[int]):
        picks = cheapest(found.filter(~F.col("shop_id").isin(gone)))
        row = cost_of(picks.withColumn("plan", F.lit(0)), "plan").first()
        return row if row and row["items"] == k else None

    gone, at = [], plan([])
    again = at is not None
    while again:
        again = False
        for s in at["shops"]:
            less = plan([*gone, s])
            if less is not None and less["cost"] < at["cost"]:
                gone, at, again = [*gone, s], less, True
                break
    rows = [(at["cost"], ",".join(map(str, at["shops"])))] if at else []
    return found.sparkSession.createDataFrame(rows, "cost double, shops string")


def best(found: DataFrame) -> DataFrame:
    """One row: cost and the shops used; exact up to 16 shops, by drop_one beyond."""
    return optimal(found) if found.select("shop_id").distinct().count() <= EXACT_SHOPS else drop_one(found)


def best_parcels(found: DataFrame) -> DataFrame:
    """The best plan's parcels, the dearest first: shop, products, goods, delivery, its days, and what is missing to free delivery."""
    used = best(found).select(F.explode(F.split("shops", ",").cast("array<bigint>")).alias("shop_id"))
    rows = parcels(cheapest(found.join(F.broadcast(used), "shop_id", "left_semi")).withColumn("plan", F.lit(0)), "plan")
    total = F.round(F.col("goods") + F.col("shipping"), 2)
    shown = F.array_join(F.transform("products", lambda p: p.cast("string")), ",")
    listed = rows.select("shop_id", shown.alias("products"), F.round("goods", 2).alias("goods"), "shipping", total.alias("total"), "q.method", eta_label(F.col("q.eta_min"), F.col("q.eta_max")).alias("eta"), "q.free", "q.over_limit", "q.estimated", F.col("gap").alias("to_free"))
    return listed.orderBy(F.desc("total"), "shop_id")


def savings(found: DataFrame) -> DataFrame:
    """One row: the best plan's cost, longest wait, whether a fee in it is an estimate, and what it saves against each product at its cheapest and against one shop."""
    used = best(found)
    rows = parcels(cheapest(found.join(F.broadcast(used.select(F.explode(F.split("shops", ",").cast("array<bigint>")).alias("shop_id"))), "shop_id", "left_semi")).withColumn("plan", F.lit(0)), "plan")
    wait = rows.agg(F.max("q.eta_max").alias("max_days"), F.coalesce(F.max((F.col("q.estimated") & (F.col("shipping") > 0)).cast("int")), F.lit(0)).alias("estimated"))
    one = F.broadcast(single_shop(found).select(F.lit(1).alias("k"), F.col("cost").alias("alone")))
    every = used.select(F.lit(1).alias("k"), "cost").join(F.broadcast(naive(found).select(F.lit(1).alias("k"), F.col("cost").alias("apart"))), "k").join(one, "k", "left").join(F.broadcast(wait.withColumn("k", F.lit(1))), "k")
    return every.select("cost", F.round(F.col("apart") - F.col("cost"), 2).alias("saved_apart"), F.coalesce(F.round(F.col("alone") - F.col("cost"), 2), F.lit(0.0)).alias("saved_alone"), "max_days", "estimated")
