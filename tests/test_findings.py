"""Queries against their SQL where the given tables are too small or too tidy to tell."""

import os
import re
import shutil

import duckdb
import pytest

from cartmill.operators import resolve
from cartmill.plans import registry


@pytest.fixture
def against_sql(spark, sf, tmp_path):
    """Runs a query, and its SQL, on the smallest tables with one replaced by the rows of a DuckDB SELECT over it; both results, sorted."""

    def run(name: str, table: str, rows: str) -> tuple[list, list]:
        folder = tmp_path / name
        shutil.copytree(sf, folder, copy_function=lambda a, b: os.symlink(a, b))
        with duckdb.connect() as db:
            place = folder / f"{table}.parquet"
            place.unlink()
            db.execute(f"create table {table} as {rows.format(given=f"'{sf}/{table}.parquet'")}")
            db.execute(f"copy {table} to '{place}' (format parquet)")
            found = db.execute(registry.oracle_sql()[name])
            names = [c[0] for c in found.description]
            want = sorted(map(repr, found.fetchall()))
        return sorted(repr(tuple(r)) for r in registry.queries()[name](spark, str(folder)).select(*names).collect()), want

    return run


def test_html_offers_large_ids_and_references(against_sql):
    """Prices from 1000 on; references without a semicolon, others than the three, and escaped ones."""
    odd = "['a &amp', 'b &quot;x&quot; &nbsp y', 'c &amp;lt; &lt;i&gt; &#65;', 'd & e &copy;', 'f &amp;amp;quot; &']"
    got, want = against_sql("q_html_offers", "pages", f"SELECT 995 + 1000 * (i // 20) + i AS page_id, 'https://h/p/' || i AS url, '<title>t</title><h1>' || ({odd})[1 + i % 5] || '</h1>' AS html FROM range(40) r(i)")
    assert got == want and len(got) == 40


REPEATED = "SELECT p_partkey + 1000 * i AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM {given}, range(5) r(i) WHERE p_partkey < 60"


def test_idf_parses_before_it_counts(spark, against_sql, tmp_path):
    """Equal titles count each time, and counting doesn't repeat the parsing."""
    got, want = against_sql("q_idf", "part", REPEATED)
    assert got == want and len(got) > 10
    plan = registry.queries()["q_idf"](spark, str(tmp_path / "q_idf"))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan


@pytest.mark.parametrize("name", ["q_candidates", "q_weighted_jaccard", "q_score"])
def test_pairs_are_not_dealt(spark, against_sql, tmp_path, name):
    """Copies' pairs as the SQL lists them, without being made distinct."""
    got, want = against_sql(name, "part", REPEATED)
    assert got == want and len(got) > 600
    plan = registry.queries()[name](spark, str(tmp_path / name))._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"Aggregate \[(\w+)#", plan)) == {"k"}  # of keys, not of pairs


def test_pairs_in_slices(spark):
    """The same pairs, whatever the slices, as a plain loop finds."""
    rows = [(i, [f"k{i % 3}", f"m{i % 5 // 2}", "all"][: 2 + (i % 7 == 0)]) for i in range(60)]
    grouped = {}
    for i, keys in rows:
        grouped.setdefault(tuple(sorted(keys)), []).append(i)
    classes = spark.createDataFrame([(m[0], m, list(k), [("w", 1.0)]) for k, m in grouped.items()], "leader long, members array<long>, keys array<string>, weighed array<struct<token:string,idf:double>>")
    want = sorted((i, j) for i, x in rows for j, y in rows if i < j and set(x) & set(y))
    for slices in ((1000, 20000), (2, 7), (1, 1)):
        assert sorted(map(tuple, resolve.expanded(resolve.class_pairs(classes, *slices)).collect())) == want
