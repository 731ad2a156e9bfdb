"""Change-only price history of a stream of observations: state is each offer's last price and stock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartmill.vocabulary import PRICE_EPSILON

POINT = "product_id long, shop_id long, observed_at timestamp, price double, in_stock boolean"
STATE = "price double, in_stock boolean"


def _points(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    price, stock = state.get if state.exists else (None, None)
    rows = pd.concat(list(batches)).sort_values(["observed_at", "price", "in_stock"])
    out = []
    for r in rows.itertuples():
        if price is None or abs(r.price - price) > PRICE_EPSILON or bool(r.in_stock) != bool(stock):
            out.append((key[0], key[1], r.observed_at, r.price, bool(r.in_stock)))
        price, stock = float(r.price), bool(r.in_stock)
    if price is not None:
        state.update((price, stock))
    yield pd.DataFrame(out, columns=["product_id", "shop_id", "observed_at", "price", "in_stock"])


def changes(seen: DataFrame) -> DataFrame:
    """Points of a stream with columns product_id, shop_id, observed_at, price, in_stock. A trigger's rows of an offer are taken in time order."""
    return seen.groupBy("product_id", "shop_id").applyInPandasWithState(_points, POINT, STATE, "append", GroupStateTimeout.NoTimeout)
