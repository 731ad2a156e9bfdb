import unicodedata

import pytest
from pyspark.sql import functions as F

from cartmill.functions import numbers, text
from cartmill.vocabulary import Vocabulary


def one(spark, values, column, ddl="t string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).coalesce(1).select(column).collect()]


def test_fold_equals_decomposition(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c not in text.HANGUL]
    rows = ["a" + "".join(every[i : i + 500]) + "b" for i in range(0, len(every), 500)]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.replace("ł", "l").replace("Ł", "L")) if not unicodedata.combining(c))
    got = one(spark, rows, text.fold(F.col("t")))
    # order of marks aside, which are gone, each character folds on its own
    assert got == ["".join(map(bare, r)) for r in rows]
    assert one(spark, ["Maggi™ №½ ①Ⅳ ㎏"], text.clean(F.col("t"))) == ["maggitm no1 2 1iv kg"]


def test_general(spark):
    values = [0.0, 1.0, 15.0, 0.42, 100.0, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234, 3.14159265, 1e21, 2e-7, None]
    assert one(spark, values, text.general(F.col("t")), "t double") == [None if v is None else f"{v:g}" for v in values]


def test_fold_and_clean(spark):
    assert one(spark, ["Łódź Café", "ﬁne", None, ""], text.fold(F.col("t"))) == ["Lodz Cafe", "fine", None, ""]
    assert one(spark, ["Mąka &amp; Ryż, 1,5 KG!"], text.clean(F.col("t"))) == ["maka ryz, 1,5 kg"]


@pytest.mark.parametrize(
    ("title", "size"),
    [
        ("Noodles 6 x 70g", (0.42, "kg", 6)),
        ("Rice 5kg X3", (15.0, "kg", 3)),
        ("Atta 1kg, Pack of 4", (4.0, "kg", 4)),
        ("Oil 1,5 l", (1.5, "l", 1)),
        ("Salt 500 g and 1 kg", (1.0, "kg", 1)),
        ("Eggs 10 szt", (10.0, "pc", 1)),
        ("Plain rice", None),
        ("", None),
        (None, None),
    ],
)
def test_sizes(spark, title, size):
    got = one(spark, [title], text.parse_size(F.col("t")))[0]
    assert (got and (got.base_value, got.base_unit, got.multipack)) == size


def test_brand_and_tokens(spark):
    v = Vocabulary()
    brand = text.extract_brand(text.clean(F.col("t")), F.col("v"), v.brands)
    rows = [("India Gate Basmati Ryz 5kg", None), ("Tata Sampannn Salt", None), ("Plain rice", "TRS"), ("Rice of unknown", "Some Tata Sampann Ltd")]
    df = spark.createDataFrame(rows, "t string, v string")
    assert [r[0] for r in df.coalesce(1).select(brand).collect()] == ["india gate", "tata", "trs", "tata sampann"]
    got = df.coalesce(1).select(text.tokens(text.clean(F.col("t")), brand, v)).collect()
    assert got[0][0] == ["basmati", "rice"]
    # the brand may stand anywhere; synonyms in Polish, Hindi and German
    rows = [("Curry Madras Łagodne TRS 100g", "trs", ["curry", "madras", "lagodne"]), ("Salt tata iodised 1kg", "tata", ["salt", "iodised"]), ("Garam Masala TRS 100g – Aromatyczna Przyprawa Indyjska", "trs", ["garam", "masala", "spice"]), ("Mąka pszenna Aashirvaad 1kg", "aashirvaad", ["flour", "wheat"]), ("Haldi hing saunf gur besan ladoo oel", None, ["turmeric", "asafoetida", "fennel", "jaggery", "besan", "laddu", "oil"]), ("Szampon do włosów, garnek i czajnik", None, ["shampoo", "hair", "pot", "kettle"]), ("Noodles mixes leaves", None, ["noodle", "mix", "leaf"])]
    df = spark.createDataFrame([(t, None) for t, _, _ in rows], "t string, v string").coalesce(1)
    assert [tuple(r) for r in df.select(brand, text.tokens(text.clean(F.col("t")), brand, v)).collect()] == [(b, t) for _, b, t in rows]


def test_prices(spark):
    values = ["1 234,56 PLN", "12.00zł", "7.00", "0", "free", None, "1234,56 zł"]
    assert one(spark, values, numbers.parse_price(F.col("t"))) == [1234.56, 12.0, 7.0, None, None, None, 234.56]
    assert one(spark, ["1,5", "", None, "x"], numbers.lenient_float(F.col("t"), 0.0)) == [1.5, 0.0, 0.0, 0.0]
    assert one(spark, [1.0, 15.0, 0.42], text.general(F.col("t")), "t double") == ["1", "15", "0.42"]


def test_units(spark):
    df = spark.createDataFrame([("2", "lbs"), ("0", "g"), (None, "kg"), ("1.5", "kg"), ("3", "stone")], "w string, u string")
    assert [r[0] for r in df.coalesce(1).select(numbers.grams(F.col("w"), F.col("u"))).collect()] == [907, None, None, 1500, 3]
