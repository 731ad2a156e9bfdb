"""Quality rules as a bitmask ledger.

Every rule is evaluated once. A document's row holds the measurements and one long whose bit i is set where
rule i fails. A policy is a version, a mask of the rules that it applies and how many of them may fail; it is
applied to the stored bits, and ablations (what a policy would keep without one of its rules) are sums over
bits, so neither reads a text again.

Measurements: n_words; word_chars, the code points in words; n_symbols, the characters of `[#*$%&|<>]`;
n_dup_lines, lines with a word that equal an earlier line; n_repeat_words, words inside a window of five
words that occurs twice or more in the text, first occurrence included.

Cases: null text is empty: all measurements 0, too_short and no_words fail. Texts of any length are measured
whole. Equal rows are rows each; an empty table gives none. Only doc_id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartmill.llm.text import SPACES, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5


def window_hashes(ws: Column, window: int = WINDOW) -> Column:
    """A hash of each window of words, in text order; null where there are fewer than two."""
    n = F.size(ws) - window
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)])))


def repeat_cover(hashes: Column, window: int = WINDOW) -> Column:
    """From the windows' hashes in text order, the words that repeated ones cover.

    (hash, place) pairs are sorted; neighbours with equal hashes are repeated windows. Their places, sorted,
    cover `window` words each, less where the next one starts sooner.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def placed(pair: Column) -> Column:
        before = F.filter(F.transform(pair, lambda p, k: F.when((k > 0) & (p["h"] == F.get(pair, k - 1)["h"]) | (p["h"] == F.get(pair, k + 1)["h"]), p["i"])), lambda x: x.isNotNull())
        return F.array_sort(before)

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - p, F.lit(window)))), F.lit(0).cast("long"), lambda s, x: s + x)

    one = F.array(pairs)
    places = F.transform(one, placed)
    return F.element_at(F.transform(places, covered), 1)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements."""
    text = F.coalesce("text", F.lit(""))
    bare = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    first = docs.select(
        "doc_id",
        words(text).alias("__w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
        F.length(text).cast("long").alias("n_chars"),
    )
    second = first.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        "n_chars",
        window_hashes(F.col("__w")).alias("__h"),
    )
    same = F.col("__h").isNull() | (F.size(F.array_distinct("__h")) == F.size("__h"))
    return second.withColumn("n_repeat_words", F.when(same, F.lit(0).cast("long")).otherwise(repeat_cover(F.col("__h")))).drop("__h")


@dataclass(frozen=True)
class Rule:
    """A rule and the column expression that is true where it fails. Its place in RULES is its bit, for good."""

    name: str
    fails: Column


def rules() -> list[Rule]:
    n, c = F.col("n_words"), F.col
    return [
        Rule("too_short", n < 10),
        Rule("repeated_windows", 100 * c("n_repeat_words") > 20 * n),
        Rule("symbols_over_words", 10 * c("n_symbols") > 3 * n),
        Rule("duplicate_lines", 100 * c("n_dup_lines") > 30 * c("n_lines")),
        Rule("short_words", c("word_chars") < 2 * n),
        Rule("long_words", c("word_chars") > 15 * n),
        Rule("no_words", n == 0),
        Rule("any_duplicate_line", c("n_dup_lines") > 0),
    ]


@dataclass(frozen=True)
class Policy:
    version: str
    rule_names: tuple[str, ...]
    may_fail: int = 0

    def mask(self) -> int:
        names = [r.name for r in rules()]
        return sum(1 << names.index(x) for x in self.rule_names)


#: base: the contract's own rules; v1 adds the rules on symbols, lines and word lengths.
POLICIES = (
    Policy("base", ("too_short", "repeated_windows")),
    Policy("v1", ("too_short", "repeated_windows", "symbols_over_words", "duplicate_lines", "short_words", "long_words", "no_words")),
)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failed_bits`."""
    bits = [F.when(r.fails, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, r in enumerate(rules())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs).withColumn("failed_bits", total)


def passes(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.bit_count(F.col(bits).bitwiseAND(F.lit(policy.mask()).cast("long"))) <= policy.may_fail


def ablations(entries: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """version, left_out (null: nothing), n_docs, n_kept, failed_or, failed_and: one row a policy and rule left out.

    The ledger is first summed up by its bits, of which there are few, so this needs one small shuffle.
    """
    by_bits = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    cases = []
    for p in policies:
        for rule in (None, *p.rule_names):
            kept = tuple(x for x in p.rule_names if x != rule)
            cases.append(F.struct(F.lit(p.version).alias("version"), F.lit(rule).cast("string").alias("left_out"), F.lit(Policy(p.version, kept).mask()).cast("long").alias("mask"), F.lit(p.may_fail).alias("may_fail")))
    spread = by_bits.select("failed_bits", "n", F.inline(F.array(*cases)))
    hit = F.col("failed_bits").bitwiseAND(F.col("mask"))
    return spread.groupBy("version", "left_out").agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(F.bit_count(hit) <= F.col("may_fail"), F.col("n")).otherwise(0)).alias("n_kept"),
        F.bit_or(hit).alias("failed_or"),
        F.bit_and(hit).alias("failed_and"),
    )


def rules_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, the ledger's bits, and the version of the policy that decides `kept` where base doesn't fail."""
    base, v1 = POLICIES
    entries = ledger(docs)
    base_failed = ~passes(base)
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & passes(v1)).alias("kept"),
        "failed_bits",
        F.lit(v1.version).alias("policy"),
    )


def ablation_report(docs: DataFrame) -> DataFrame:
    """What each policy keeps, and what it would keep without each of its rules."""
    return ablations(ledger(docs))
