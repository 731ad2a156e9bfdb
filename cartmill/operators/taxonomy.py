"""Categories and sub-categories from canonical tokens: most tokens of a rule, then the higher tier, then the earlier rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartmill.vocabulary import FALLBACK, HOUSEHOLD_OVERRIDES, categories, subcategories


def _literal(words: list[str] | tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value's own expression in it once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def category(tokens: Column) -> Column:
    """The category's slug. The rules are one array literal; the best of (hits, tier, -place) wins."""

    def best_of(ts: Column) -> Column:
        hits = [F.struct(F.size(F.array_intersect(ts, _literal(words))).alias("hits"), F.lit(tier).alias("tier"), F.lit(-i).alias("place"), F.lit(slug).alias("slug")) for i, (slug, _, tier, words) in enumerate(categories())]
        found = lambda best: F.when(best["hits"] > 0, best["slug"]).otherwise(F.lit(FALLBACK[0]))
        return F.when(F.arrays_overlap(ts, _literal(HOUSEHOLD_OVERRIDES)), F.lit("household")).otherwise(_bound(F.array_max(F.array(*hits)), found))

    return _bound(tokens, best_of)


def label(slug: Column) -> Column:
    pairs = [F.lit(x) for s, text, _, _ in categories() for x in (s, text)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), slug), F.lit(FALLBACK[1]))


def subcategory(parent: Column, tokens: Column) -> Column:
    """The parent's rule with most tokens, the first of equals; null if none has any."""

    def best_of(given: Column) -> Column:
        rules = [F.struct(F.when(given["parent"] == p, F.size(F.array_intersect(given["tokens"], _literal(words)))).otherwise(0).alias("hits"), F.lit(-i).alias("place"), F.lit(slug).alias("slug")) for p, slug, i, words in subcategories()]
        return _bound(F.array_max(F.array(*rules)), lambda best: F.when(best["hits"] > 0, best["slug"]))

    return _bound(F.struct(parent.alias("parent"), tokens.alias("tokens")), best_of)
