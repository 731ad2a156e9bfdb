"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line of seconds a query.

Each query runs once to warm up and then three times into the noop sink; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
HEADLINE = (
    "q_search_price",
    "q_search_words",
    "q_facets_comparable",
    "q_product_summary",
    "q_shop_prices",
    "q_price_changes",
    "q_upsert",
    "q_weighted_jaccard",
    "q_match",
    "q_category",
    "q_ship_quote",
    "q_basket_optimal",
    "q_html_offers",
)
RUNS = 3


def main() -> None:
    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    sys.path.insert(0, str(ROOT))
    from cartmill.plans import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    with tempfile.TemporaryDirectory() as place:
        spark = (
            SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", f"file://{place}/shared")
            .config("spark.sql.warehouse.dir", f"file://{place}/warehouse")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("OFF")
        queries, seconds = registry.queries(), {}
        for name in HEADLINE:
            took = []
            for _ in range(1 + RUNS):
                began = time.time()
                queries[name](spark, sf).write.format("noop").mode("overwrite").save()
                took.append(time.time() - began)
            seconds[name] = round(median(took[1:]), 3)
        spark.stop()
    print(json.dumps({"metric": "headline query seconds, sum of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
