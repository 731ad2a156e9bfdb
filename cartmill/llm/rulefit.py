"""A quality classifier as a sparse ensemble of rules (after Friedman and Popescu, 2008).

Boosted trees over text statistics are grown on a sample of labelled documents. Every path from a root to a
node is a rule: a conjunction of comparisons. A logistic model with a lasso penalty gives each rule a weight,
most of them 0. The rules that are left become one Spark column expression, so scoring runs where the text is.

The sample holds about SAMPLE labelled documents (never more than twice as many rows, also where ids repeat), chosen
by a hash of doc_id; everything else covers all data. lang, source and doc_id are never inputs of a score.

Cases: null and blank texts have statistics of 0. Repeated labels of a document are averaged, and count as 1
from 0.5 on; null labels are left out. Without labels, or with labels of one class only, every score is the smoothed share of label 1.
Equal rows are rows each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartmill.llm.text import SPACES, scratch, words

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST = 24, 3, 32, 0.3, 20
PENALTIES = (0.02, 0.005, 0.001)
KEEP = 0.7
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"

STATISTICS = ("n_words", "mean_word", "symbols", "bars", "marks", "capitals", "digits", "stops", "distinct", "duplicate_lines", "line_words")


def statistics(text: Column) -> Column:
    """A struct of STATISTICS: counts of kinds of characters and words, as shares of words or characters."""
    t = F.coalesce(text, F.lit(""))

    def of(chars: str) -> Column:
        return F.length(t) - F.length(F.translate(t, chars, ""))

    def build(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("double")
        lines = F.split(t, "\n")
        chars = F.greatest(F.length(t) - of(SPACES), F.lit(1)).cast("double")
        values = (
            F.size(w).cast("double"),
            chars / n,
            of("#*$%&<>@~^_=") / n,
            of("|") / n,
            of("!?") / n,
            of(UPPER) / chars,
            of("0123456789") / chars,
            of(".,;:") / n,
            F.size(F.array_distinct(w)) / n,
            (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines).cast("double"),
            n / F.size(lines).cast("double"),
        )
        return F.struct(*[v.cast("double").alias(name) for name, v in zip(STATISTICS, values, strict=True)])

    return F.element_at(F.transform(F.array(words(t)), build), 1)


@dataclass(frozen=True)
class Condition:
    """statistic <= bound, or > bound."""

    statistic: int
    bound: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.statistic] > self.bound if self.above else x[:, self.statistic] <= self.bound

    def column(self) -> Column:
        c = F.col(f"stats.{STATISTICS[self.statistic]}")
        return c > self.bound if self.above else c <= self.bound


Rule = frozenset  # of Condition


@dataclass
class Node:
    value: float
    split: tuple[int, float] | None = None
    sides: list[Node] = field(default_factory=list)


def grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int) -> Node:
    """A regression tree on gradients by Newton gain over histograms."""
    g, h = gradient.sum(), weight.sum()
    node = Node(float(g / (h + 1.0)))
    if depth == 0 or len(x) < 2 * LEAST:
        return node
    best, found = 1e-6, None
    for s, bounds in enumerate(cuts):
        if not len(bounds):
            continue
        k = len(bounds) + 1
        gs, hs, ns = (np.bincount(binned[:, s], v, k).cumsum()[:-1] for v in (gradient, weight, np.ones(len(x))))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST) | (len(x) - ns < LEAST)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best:
            best, found = gain[at], (s, at)
    if found:
        s, at = found
        left = binned[:, s] <= at
        node.split = (s, float(cuts[s][at]))
        node.sides = [grow(x[m], binned[m], cuts, gradient[m], weight[m], depth - 1) for m in (left, ~left)]
    return node


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.split is None:
        return np.full(len(x), node.value)
    s, bound = node.split
    return np.where(x[:, s] <= bound, predict(node.sides[0], x), predict(node.sides[1], x))


def paths(node: Node, above: frozenset = frozenset()) -> list[frozenset]:
    """All rules of a tree: the conjunction on the way to each node but the root."""
    if node.split is None:
        return []
    s, bound = node.split
    out = []
    for side, is_above in zip(node.sides, (False, True), strict=True):
        # of two bounds on one side the tighter one says it all
        same = [c for c in above if c.statistic == s and c.above == is_above]
        tight = bound if not same else (max if is_above else min)(bound, *[c.bound for c in same])
        rule = frozenset([*(c for c in above if c not in same), Condition(s, tight, is_above)])
        out += [rule, *paths(side, rule)]
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal gradient."""
    n, k = z.shape
    full = np.concatenate([np.ones((n, 1)), z], axis=1)
    step = 4.0 / max(1e-9, np.linalg.norm(full.T @ full / n, 2))
    w = np.zeros(k + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -30, 30)))
        new = v - step * (full.T @ (p - y) / n)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / grown * (new - w), new, grown
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[tuple[frozenset, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            total += w * np.logical_and.reduce([c.holds(x) for c in rule])
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score over a column `stats`."""
        total = F.lit(self.intercept)
        for rule, w in self.rules:
            held = F.lit(True)
            for c in sorted(rule, key=lambda c: (c.statistic, c.above)):
                held = held & c.column()
            total = total + F.when(held, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        text = lambda c: f"{STATISTICS[c.statistic]} {'>' if c.above else '<='} {c.bound:.4g}"
        return [f"{w:+.3f} if {' and '.join(map(text, sorted(r, key=lambda c: c.statistic)))}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Grows trees, takes their rules, and chooses the penalty by a fifth of the rows, held back."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(y) == 0 or y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, BINS + 1)[1:-1])) for s in range(x.shape[1])]
    cuts = [c[c < x[:, s].max()] for s, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, s], "left") for s, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    rules: dict[frozenset, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(x, binned, cuts, y - p, np.maximum(p * (1 - p), 1e-6), DEPTH)
        margin = margin + RATE * predict(tree, x)
        rules |= dict.fromkeys(paths(tree))
    every = list(rules)
    if not every:
        return Model(float(np.log(share / (1 - share))), ())
    z = np.stack([np.logical_and.reduce([c.holds(x) for c in r]) for r in every], axis=1).astype(float)
    back = np.arange(len(y)) % 5 == 4

    def loss(penalty: float) -> float:
        a, w = lasso(z[~back], y[~back], penalty)
        p = np.clip(1 / (1 + np.exp(-(a + z[back] @ w))), 1e-6, 1 - 1e-6)
        return float(-(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)).mean())

    a, w = lasso(z, y, min(PENALTIES, key=loss) if back.any() and len(set(y[~back])) == 2 else PENALTIES[0])
    return Model(a, tuple((r, float(v)) for r, v in zip(every, w, strict=True) if abs(v) > 1e-6))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def train(stats: DataFrame, labels: DataFrame) -> Model:
    """From (doc_id, stats) rows and labels of documents that may be learned from."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = known.filter(~held_out(F.col("doc_id")))
    n, span = known.count(), 1 << 40
    if n > SAMPLE:
        known = known.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(span)) < span * SAMPLE // n)
    rows = stats.join(known, "doc_id").select("doc_id", "y", "stats.*").orderBy(F.xxhash64("doc_id"), *STATISTICS).limit(2 * SAMPLE).collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], float).reshape(len(rows), len(STATISTICS))
    return fit(x, np.array([r["y"] for r in rows], float))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document. Statistics are computed once and written to the shared folder."""
    spark = docs.sparkSession
    path = scratch(spark, "rulefit")
    docs.select("doc_id", statistics(F.col("text")).alias("stats")).write.parquet(path)
    stats = spark.read.parquet(path)
    model = train(stats, labels)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))
