"""An interpolated modified Kneser-Ney bigram model, counted in Spark over all training documents.

Counting. Tasks turn words into 64-bit hashes and send packed arrays of distinct words, then of distinct
bigrams, to buckets. A bucket of bigrams belongs to their first words, but for words so frequent that one
bucket could not hold their bigrams: those are dealt by both words. Nothing is pruned or sampled, so what
is gathered grows with the corpus.

Storage. Each bucket is a file of sorted hash arrays with counts in the shared folder. Workers map files into
memory, straight from a shared file system and else from a copy that vanishes with its last reader. Scoring
looks up a chunk's distinct words and bigrams by binary search; no model is broadcast.

Probability of a token w after v, with counts c and discounts D estimated from counts of counts:
    P(w|v)  = (c(vw) - D(c(vw))) / c(v) + g(v) * Pc(w),   g(v) = (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v)
    Pc(w)   = (k(w) - E(k(w))) / K + h / (V + 1),         h = (E1 m1 + E2 m2 + E3 m3) / K
where k(w) counts the distinct words before w, K is the number of distinct bigrams, ni(v) the words that follow
v once, twice, or oftener, mi the words with that k, E its discounts, and V the number of distinct tokens. After an unseen v it is Pc(w).

Cases: null and blank texts have the end token only. A null doc_id trains. Equal rows count as rows each. With
no training documents, every token has probability 1/(V+1) = 1. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartmill.llm.hasharrays import ROWS, by_bucket, deal, find, mapped, pack, rows, smallest, split, store, summed, unpack
from cartmill.llm.text import scratch
from cartmill.llm.wordhash import Words, chunks, mix64

#: Hashes that stand for the beginning and end of a text.
BEGIN, END = np.uint64(0xB0B0B0B0B0B0B0B1), np.uint64(0xE0E0E0E0E0E0E0E1)
SALT = np.uint64(0xA24BAED4963EE407)
TOKENS_PER_BUCKET = 3_000_000
#: Buckets of words follow the bytes of text, which bound their number.
BYTES_PER_WORD_BUCKET = 24 << 20
FLUSH_TOKENS = 3_000_000
SCORE_BYTES = 1 << 21


# ---- tokens --------------------------------------------------------------------------------------------------------


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a chunk with an end token to each document, the token before each, and each document's number of tokens."""
    counts = w.counts + 1
    ends = np.cumsum(counts) - 1
    token = np.empty(len(w.hashes) + len(counts), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[is_end], token[~is_end] = END, w.hashes
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - w.counts] = BEGIN
    return token, before, counts


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(v * SALT + w)


def bucket_of(v: np.ndarray, key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each bigram: by its first word, or by its own hash where the first word is hot."""
    by = mix64(v)
    if len(hot):
        by = np.where(hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v, key, by)
    return (by % np.uint64(n)).astype(np.int64)


def _count_words(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            return rows([(b, pack([word[i], smallest(count[i])])) for b, i in split((mix64(word) % np.uint64(n)).astype(np.int64))])

        for batch in batches:
            for w in chunks(batch.column(0)):
                held.append(tokens(w)[0])
                size += len(held[-1])
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _count_bigrams(n: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            v, w = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, count = np.unique(bigram(v, w), return_index=True, return_counts=True)
            v, w = v[first], w[first]
            found = []
            for b, i in split(bucket_of(v, key, hot, n)):
                i = i[np.argsort(v[i], kind="stable")]
                heads, begin = np.unique(v[i], return_index=True)
                found.append((b, pack([heads, smallest(np.diff(np.append(begin, len(i)))), w[i], smallest(count[i])])))
            return rows(found)

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                token, before, _ = tokens(chunk)
                held.append((before, token))
                size += len(token)
                if size >= FLUSH_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, held in by_bucket(batches):
        if not held:
            continue
        word, count = summed(*(np.concatenate([x.astype(np.uint64) for x in c]) for c in zip(*map(unpack, held), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([pack([word, smallest(count)])], pa.binary()), pa.array([len(word)], pa.int64()), pa.array([int(count.sum())], pa.int64())], ["bucket", "data", "types", "total"])


def _merge_bigrams(folder: str, n_words: int):
    """Stores each bucket's bigrams; gives what its words' entries need, for the words' buckets, and counts of counts (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in by_bucket(batches):
            v, w, c = [], [], []
            for x in held:
                heads, lengths, tails, counts = unpack(x)
                v.append(np.repeat(heads, lengths.astype(np.int64)))
                w.append(tails)
                c.append(counts.astype(np.uint64))
            none = np.zeros(0, np.uint64)
            v, w, c = (np.concatenate([none, *x]) for x in (v, w, c))
            key = bigram(v, w)
            order = np.argsort(key, kind="stable")
            key, v, w, c = key[order], v[order], w[order], c[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
            key, v, w, c = key[first], v[first], w[first], np.add.reduceat(c, first) if len(c) else c
            many = np.flatnonzero(c >= 255)
            store(folder, f"bigrams-{b}", [key, np.minimum(c, 255).astype(np.uint8), many.astype(np.uint64), c[many]])
            one, two, more = (c == 1), (c == 2), (c >= 3)
            word, *facts = summed(np.concatenate([v, w]), *(np.concatenate(x) for x in ((np.zeros(len(v)), np.ones(len(w))), *((x, np.zeros(len(w))) for x in (one, two, more)))))
            found = [(i, pack([word[at], *(smallest(f[at]) for f in facts)])) for i, at in split((mix64(word) % np.uint64(n_words)).astype(np.int64))]
            found.append((-1, pack([np.array([np.count_nonzero(c == k) for k in (1, 2, 3, 4)] + [len(c)], np.uint64)])))
            yield rows(found)

    return run


def _join_words(folder: str):
    """Stores each bucket's words with c, k, n1, n2, n3; gives counts of counts of k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in by_bucket(batches):
            word, facts = [], [[] for _ in range(5)]
            for x in held:
                got = unpack(x)
                word.append(got[0])
                full = [got[1], *[np.zeros(len(got[0]), np.uint64)] * 4] if len(got) == 2 else [np.zeros(len(got[0]), np.uint64), *got[1:]]
                for f, g in zip(facts, full, strict=True):
                    f.append(g.astype(np.uint64))
            none = np.zeros(0, np.uint64)
            word, *facts = summed(np.concatenate([none, *word]), *(np.concatenate([none, *f]) for f in facts))
            store(folder, f"words-{b}", [word, *map(smallest, facts)])
            k = facts[1]
            yield rows([(b, pack([np.array([np.count_nonzero(k == i) for i in (1, 2, 3, 4)] + [np.count_nonzero(k >= 3)], np.uint64)]))])

    return run


# ---- model ---------------------------------------------------------------------------------------------------------


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of Chen and Goodman (1998), each kept within 0 and its count; 0.5, 1, 1.5 where counts of counts are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(min(max(x, 0.0), k - 0.01) for k, x in enumerate(d, 1))


@dataclass(frozen=True)
class Model:
    """Where a model's files are, and its few global numbers."""

    folder: str
    word_buckets: int
    bigram_buckets: int
    hot: np.ndarray
    tokens: int
    types: int
    bigram_types: int
    d: tuple[float, float, float]
    e: tuple[float, float, float]
    k_types: tuple[int, int, int]

    @property
    def floor(self) -> float:
        """What Pc gives a word never seen."""
        if not self.bigram_types:
            return 1.0 / (self.types + 1)
        return sum(a * b for a, b in zip(self.e, self.k_types, strict=True)) / self.bigram_types / (self.types + 1)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def train(docs: DataFrame, text: str = "text") -> Model:
    """Counts all the given documents and stores the model in the shared folder."""
    spark = docs.sparkSession
    folder = scratch(spark, "ngram")
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path)
    texts = docs.select(text)
    size = texts.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_words = max(8, math.ceil(size / BYTES_PER_WORD_BUCKET))
    deal(texts.mapInArrow(_count_words(n_words), ROWS), n_words).mapInArrow(_merge_words, f"{ROWS}, types long, total long").write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    types, total = (int(x or 0) for x in words.agg(F.sum("types"), F.sum("total")).first())
    n_bigrams = max(8, math.ceil(total / TOKENS_PER_BUCKET))
    hot = _hot(words, total / (4 * n_bigrams), path=folder)
    deal(texts.mapInArrow(_count_bigrams(n_bigrams, hot), ROWS), n_bigrams).mapInArrow(_merge_bigrams(folder, n_words), ROWS).write.parquet(f"{folder}/facts")
    facts = spark.read.parquet(f"{folder}/facts")
    coc = sum((unpack(bytes(r[0]))[0].astype(np.int64) for r in facts.filter("bucket < 0").select("data").toLocalIterator()), np.zeros(5, np.int64)).tolist()
    both = words.select("bucket", "data").unionByName(facts.filter("bucket >= 0"))
    ends = deal(both, n_words).mapInArrow(_join_words(folder), ROWS).select("data").collect()  # five numbers a bucket
    k = sum((unpack(bytes(r[0]))[0].astype(np.int64) for r in ends), np.zeros(5, np.int64)).tolist()
    return Model(folder, n_words, n_bigrams, hot, total, types, coc[4], discounts(*coc[:4]), discounts(*k[:4]), (k[0], k[1], k[4]))


def _hot(words: DataFrame, least: float, path: str) -> np.ndarray:
    """Hashes of the words with more tokens than `least`, and of the text's beginning; there are total / least of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                word, count = unpack(x)
                yield pa.RecordBatch.from_arrays([pa.array(word[count > least].view(np.int64))], ["word"])

    found = np.array([r[0] for r in words.select("data").mapInArrow(run, "word long").collect()], np.int64).view(np.uint64)
    return np.unique(np.append(found, BEGIN))


class Reader:
    """A worker's view of a model: files are mapped when first needed."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def _file(self, name: str) -> list[np.ndarray]:
        if name not in self.files:
            self.files[name] = mapped(self.model.folder, name)
        return self.files[name]

    def words(self, word: np.ndarray) -> np.ndarray:
        """c, k, n1, n2, n3 of each distinct word; zeros for unseen ones."""
        out = np.zeros((5, len(word)), np.float64)
        n = self.model.word_buckets
        for b, at in split((mix64(word) % np.uint64(n)).astype(np.int64)):
            got = self._file(f"words-{b}")
            place, known = find(got[0], word[at])
            for row, column in zip(out, got[1:], strict=True):
                row[at[known]] = column[place]
        return out

    def bigrams(self, v: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.float64)
        n = self.model.bigram_buckets
        for b, at in split(bucket_of(v, key, self.model.hot, n)):
            got = self._file(f"bigrams-{b}")
            place, known = find(got[0], key[at])
            count = got[1][place].astype(np.float64)
            many = np.flatnonzero(count == 255)
            count[many] = got[3][np.searchsorted(got[2], place[many].astype(np.uint64))]
            out[at[known]] = count
        return out

    def log10(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score and score of each document of a chunk."""
        m = self.model
        token, before, counts = tokens(w)
        # words and contexts are looked up together, once each
        word, where = np.unique(np.concatenate([token, before]), return_inverse=True)
        c, k, n1, n2, n3 = self.words(word)
        c[word == BEGIN] = n1[word == BEGIN] = 0
        wi, vi = where[: len(token)], where[len(token) :]
        key, first, back = np.unique(bigram(before, token), return_index=True, return_inverse=True)
        v, t = vi[first], wi[first]
        n = self.bigrams(before[first], key)
        d = np.array([0.0, *m.d])
        e = np.array([0.0, *m.e])
        at_most = lambda x: np.minimum(x, 3).astype(np.int64)
        lower = np.full(len(word), m.floor)
        if m.bigram_types:
            lower += np.maximum(k - e[at_most(k)], 0) / m.bigram_types
        starts = word == BEGIN
        total = np.where(starts, self.begins(), c)
        if starts.any():
            n1, n2, n3 = (np.where(starts, x, y) for x, y in zip(self.begin_facts(), (n1, n2, n3), strict=True))
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(total > 0, (m.d[0] * n1 + m.d[1] * n2 + m.d[2] * n3) / total, 1.0)
            direct = np.where(total[v] > 0, np.maximum(n - d[at_most(n)], 0) / total[v], 0.0)
        p = np.log10(direct + weight[v] * lower[t])
        base = np.log10((c + 1) / (m.tokens + 1 * (m.types + 1)))
        doc = np.repeat(np.arange(len(counts)), counts)
        sums = lambda x: np.bincount(doc, x, len(counts))
        return counts, sums(c[wi] > 0).astype(np.int64), sums(base[wi]), sums(p[back])

    def begin_facts(self) -> list[float]:
        """n1, n2, n3 of the text's beginning."""
        if not hasattr(self, "_begin"):
            self._begin = self.words(np.array([BEGIN]))[:, 0].tolist()
        return self._begin[2:]

    def begins(self) -> float:
        """How often the text's beginning came: as often as its end."""
        if not hasattr(self, "_begins"):
            self._begins = float(self.words(np.array([END]))[0, 0])
        return self._begins


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and the scores of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            got = [reader.log10(w) for w in chunks(batch.column(2), SCORE_BYTES)]
            if got:
                n, known, base, p = (np.concatenate(x) for x in zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(p)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCORED)


def score_report(docs: DataFrame) -> DataFrame:
    """The contract's columns and the perplexity of each text."""
    scored = score(docs, train(docs.filter(~held_out(F.col("doc_id")))))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
