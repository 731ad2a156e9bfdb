"""Titles as expressions: folding, cleaning, pack sizes, brands, canonical tokens, match keys."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartmill.vocabulary import BRANDS, NON_PRODUCT, STOPWORDS, UNITS, Vocabulary

UNIT = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
# ---- fixed values: the forms of sizes in titles, which must equal those of the system whose results are matched ---
NUMBER = r"\d+(?:[.,]\d+)?"
MULTIPACK = rf"(?i)(?<![\w.])(\d{{1,3}})\s*[x×]\s*({NUMBER})\s*({UNIT})(?![a-z])"
SUFFIX_PACK = rf"(?i)(?<![\w.])({NUMBER})\s*({UNIT})\s*[x×]\s*(\d{{1,3}})(?![\w.])"
PACK_OF = r"(?i)\b(?:pack|bundle|combo|set|zestaw)\s+(?:of\s+)?(\d{1,3})\b"
SIZE = rf"(?i)(?<![\w.])({NUMBER})\s*({UNIT})(?![a-z])"
# ---- end of fixed values ------------------------------------------------------------------------------------------
SIZE_TYPE = "struct<value:double,unit:string,base_unit:string,base_value:double,multipack:int>"


HANGUL = range(0xAC00, 0xD7A4)


@cache
def _fold_table() -> tuple[str, str, str, str]:
    """From Unicode's compatibility decompositions without combining marks: characters that become one, and what
    each becomes (marks, which have no partner there, go); those that become several, and `c=several|...` of them.
    """
    plain, several = {"ł": "l", "Ł": "L"}, {}
    marks = []
    for c in (chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and i not in HANGUL):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            marks.append(c)
        elif bare != c and c not in plain:
            (plain if len(bare) == 1 else several)[c] = bare
    # the two signs of the table's text can't stand in it: no character that is folded holds them
    several = {c: b for c, b in several.items() if "\0" not in b and "\1" not in b}
    return "".join([*plain, *marks]), "".join(plain.values()), "".join(several), "\0".join(f"{c}\1{b}" for c, b in several.items())


def fold(text: Column) -> Column:
    """Without combining marks, in compatibility form, and ł as l; Hangul stays as it is (all letters but ASCII's become spaces when cleaned).

    ASCII stays as it is. One translate for all characters that become one or none; only texts with one that becomes
    several are taken apart.
    """
    letters, bare, wide, table = _fold_table()
    out = F.translate(text, letters, bare)
    become = F.str_to_map(F.lit(table), F.lit("\0"), F.lit("\1"))
    expanded = F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.try_element_at(become, c), c)), "")
    folded = F.when(F.length(F.translate(out, wide, "")) < F.length(out), expanded).otherwise(out)
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(folded)


def clean(text: Column) -> Column:
    """Folded lower case of letters, digits, . , x and -, single spaces."""
    return clean_folded(F.lower(fold(text)))


def clean_folded(folded: Column) -> Column:
    """`clean` of a text that is folded and lower case already: folding is dear where several columns are read from one text."""
    out = F.regexp_replace(folded, "&[a-z]+;", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9.,×x\s-]", " "), r"\s+", " "))


def is_product(title: Column) -> Column:
    """Not a delivery fee, gift card or the like."""
    return ~F.lower(fold(F.coalesce(title, F.lit("")))).rlike("|".join(NON_PRODUCT))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def _unit(name: str) -> Column:
    pairs = [x for u, (base, factor) in UNITS.items() for x in (F.lit(u), F.lit(factor if name == "factor" else base))]
    return F.create_map(*pairs)


def _size(value: Column, unit: Column, times: Column) -> Column:
    base = F.round(value * F.try_element_at(_unit("factor"), unit) * times, 6)
    return F.struct(value.alias("value"), unit.alias("unit"), F.try_element_at(_unit("base"), unit).alias("base_unit"), base.alias("base_value"), times.cast("int").alias("multipack")).cast(SIZE_TYPE)


def parse_size(text: Column) -> Column:
    """The pack size that a title states, or null: `6 x 70g`, then `5kg x 3`, then `pack of 4` of the largest size, then the largest size."""
    return parse_folded_size(F.lower(fold(F.coalesce(text, F.lit("")))))


def parse_folded_size(t: Column) -> Column:
    """`parse_size` of a text that is folded and lower case already, not null."""
    one = F.lit(1)
    part = lambda pattern, i: F.nullif(F.regexp_extract(t, pattern, i), F.lit(""))
    front = _size(number(part(MULTIPACK, 2)), part(MULTIPACK, 3), part(MULTIPACK, 1).cast("int"))
    back = _size(number(part(SUFFIX_PACK, 1)), part(SUFFIX_PACK, 2), part(SUFFIX_PACK, 3).cast("int"))
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(SIZE), F.lit(1)).alias("v"), F.regexp_extract_all(t, F.lit(SIZE), F.lit(2)).alias("u"))
    sized = F.transform(found, lambda x, i: F.struct((number(x["v"]) * F.try_element_at(_unit("factor"), x["u"])).alias("b"), (-i).alias("i"), x["v"].alias("v"), x["u"].alias("u")))
    largest = F.array_max(sized)
    count = part(PACK_OF, 1).cast("int")
    single = _size(number(largest["v"]), largest["u"], F.when(count > 1, count).otherwise(one))
    return F.when(part(MULTIPACK, 1).isNotNull(), front).when(part(SUFFIX_PACK, 1).isNotNull(), back).when(F.size(found) > 0, single)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def extract_brand(cleaned: Column, vendor: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """Longest brand of several words at word boundaries, else the first of the words that are brands, else the vendor or a brand of several words in it."""
    return brand_of(cleaned, clean(F.coalesce(vendor, F.lit(""))), brands)


def brand_of(cleaned: Column, maker: Column, brands: tuple[str, ...] = BRANDS) -> Column:
    """`extract_brand` with the vendor cleaned already, empty if there is none."""
    several = F.array(*map(F.lit, sorted((b for b in brands if " " in b), key=lambda b: (-len(b), b)))) if any(" " in b for b in brands) else F.array().cast("array<string>")
    known = F.array(*map(F.lit, sorted(brands)))
    inside = F.get(F.filter(several, lambda b: F.contains(cleaned, b) & F.regexp_like(cleaned, F.concat(F.lit(r"\b"), b, F.lit(r"\b")))), F.lit(0))
    return F.coalesce(
        inside,
        F.get(F.filter(_words(cleaned), lambda w: F.array_contains(known, w)), F.lit(0)),
        F.when(F.array_contains(known, maker), maker),
        F.get(F.filter(several, lambda b: F.contains(maker, b)), F.lit(0)),
    )


def tokens(cleaned: Column, brand: Column, vocabulary: Vocabulary) -> Column:
    """Canonical tokens in title order: without brand, sizes, stopwords and numbers; synonyms folded; each once."""
    stop = F.array(*map(F.lit, STOPWORDS))
    same = F.create_map(*[F.lit(x) for pair in sorted(vocabulary.synonyms.items()) for x in pair])
    bare = F.when(brand.isNotNull(), F.regexp_replace(cleaned, F.concat(F.lit(r"\b"), brand, F.lit(r"\b")), F.lit(" "))).otherwise(cleaned)
    for pattern in (MULTIPACK, SUFFIX_PACK, SIZE):
        bare = F.regexp_replace(bare, pattern, " ")
    trimmed = F.transform(_words(bare), lambda w: F.btrim(w, F.lit("-.,")))
    kept = F.filter(trimmed, lambda w: (w != "") & ~F.array_contains(stop, w) & ~F.translate(w, ".,", "").rlike("^[0-9]*$"))
    canonical = F.transform(kept, lambda w: F.coalesce(F.try_element_at(same, w), w))
    return F.array_distinct(F.filter(canonical, lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w)))


def core(token_list: Column) -> Column:
    return F.array_join(F.array_sort(token_list), " ")


def general(x: Column) -> Column:
    """A number as %g writes it: six digits at most, no trailing zeros, an exponent below -4 and from 6 on."""
    written = F.format_string("%.5e", x)
    power = F.split_part(written, F.lit("e"), F.lit(2))
    bare = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    fixed = bare(written.try_cast("double").try_cast("decimal(38,10)").cast("string"))
    wide = F.concat(bare(F.split_part(written, F.lit("e"), F.lit(1))), F.lit("e"), power)
    return F.when(x == 0, F.lit("0")).when(power.try_cast("int").between(-4, 5), fixed).when(x.isNotNull(), wide)


def size_tag(base_value: Column, base_unit: Column) -> Column:
    return F.coalesce(F.concat(general(base_value), base_unit), F.lit("_"))


def match_key(brand: Column, token_list: Column, tag: Column) -> Column:
    head = F.array_join(F.slice(F.array_sort(token_list), 1, 3), "-")
    return F.concat_ws("|", F.coalesce(brand, F.lit("_")), F.when(head == "", F.lit("_")).otherwise(head), tag)


def slugify(name: Column) -> Column:
    return F.substring(F.btrim(F.regexp_replace(F.lower(fold(name)), "[^a-z0-9]+", "-"), F.lit("-")), 1, 200)
