"""The pipeline stage by stage against what each operator's brute force says, on a small fixture."""

import random
import zlib

import pytest

import corpus_pipeline
from cartmill.llm import mixing

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    english, french = "the cat and dog with them was here for all of us today".split(), "le chat et chien avec eux dans une maison pour tous".split()
    rows = [(i, " ".join(rnd.choices(english if i % 2 else french, k=40)) + f" mark{i}", "en" if i % 2 else "fr", f"s{i % 4}", None) for i in range(80)]
    rows += [(100, rows[0][1], "fr", "s0", 1), (101, rows[1][1] + " more", "en", "s1", 2), (102, None, None, None, None), (103, "12 34", None, "s1", None), rows[5]]
    item = " ".join(f"q{i}" for i in range(30))
    rows += [(104, rows[3][1][:60] + " " + item + " the cat and dog", "en", "s2", 3)]
    place = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return str(place), rows


def test_stages(spark, folder):
    place, rows = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontaminate", "mix", "shards"]
    docs, kept = spark.read.parquet(f"{place}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, place).write.parquet(f"{place}/{i}")
        docs = spark.read.parquet(f"{place}/{i}")
        kept[name] = docs.collect()
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: sorted(r["doc_id"] for r in kept[n])
    assert ids("language") == sorted(r[0] for r in rows if r[0] not in (102, 103))
    assert ids("near_duplicates") == sorted({r[0] for r in rows} - {100, 101, 102, 103})
    assert ids("decontaminate") == sorted({r[0] for r in rows} - {100, 101, 102, 103, 104})
    assert set(ids("mix")) <= set(ids("decontaminate")) and max(map(ids("mix").count, ids("mix"))) <= 3
    assert len(ids("shards")) == len(ids("mix"))
    slots = {}
    for r in kept["shards"]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_and_empty(spark, folder, tmp_path):
    place, _ = folder
    first = sorted((r["doc_id"], r["shard"], zlib.crc32(r["text"].encode())) for r in corpus_pipeline.run(spark, place).collect())
    again = sorted((r["doc_id"], r["shard"], zlib.crc32(r["text"].encode())) for r in corpus_pipeline.run(spark, place).collect())
    assert first == again and first
    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_decides_by_row(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(40))
    a, b, c, d, e, f, g, h = (text() for _ in range(8))
    rows = [
        (1, a, "en", "s", 1), (None, a, "en", "s", 1), (None, b, "en", "s", 1),  # a null id linked to an id; a clean null id
        (3, c, "en", "s", 1), (5, c, "en", "s", 1), (5, d, "en", "s", 1),  # id 5 is a copy once and clean once
        (None, e, "en", "s", 1), (None, e + " more", "en", "s", 1), (None, e, "fr", "s", 1),  # a group without any id
        (7, f, "en", "s", 1), (7, f + " more", "en", "s", 1), (8, f, "en", "s", 1),  # near copies that share the least id
        (9, g, "en", "s", 1), (9, g, "en", "s", 1), (9, h, None, "s", 1), (10, h, "en", "s", 1),  # equal rows; nulls elsewhere
        (None, "", "en", "s", 1), (None, "", "fr", "s", 1), (11, None, None, "s", 1), (11, None, "s", None, 1), (11, " ", "en", "s", 1),  # empty sets
    ]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    got = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    group = lambda r: r[1].removesuffix(" more") if (r[1] or "").strip() else r
    assert len(got) == len(set(got)) and set(got) <= set(rows)
    assert sorted(map(str, map(group, got))) == sorted(map(str, set(map(group, rows))))
    ids = {group(r): r[0] for r in got}
    assert [ids[x] for x in (a, b, c, d, e, f, g, h)] == [1, None, 3, 5, None, 7, 9, 9]
    again = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(5), str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_deals_each_copy_where_its_schedule_reaches(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, f"t{i} " * rnd.randint(1, 20), "en" if i % 5 else None, "abc"[i % 3], i if i % 7 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    plan = [(t, r["doc_id"]) for r in mixing.mix_report(docs).collect() for t in r["positions"]]
    got = corpus_pipeline.mix(spark, docs, str(tmp_path)).collect()
    assert [r["doc_id"] for r in got] == [i for _, i in sorted(plan)]
    assert {tuple(r) for r in got} <= set(rows) and len(got) > len({i for _, i in plan})
