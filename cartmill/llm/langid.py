"""Language identification by unigram piece models that sum over all segmentations of a word.

The pieces come from a fixed public vocabulary: all its pieces of letters only, in lower case. For each language,
expectation-maximisation estimates the pieces' probabilities from a bounded sample. A word (a run of letters of any
length) has as its probability the sum over all its segmentations, by the forward algorithm, for all languages and
many words at once; only the last columns are kept, rescaled as they shrink. Words are independent; a text's
language has the greatest posterior.

The sample: about DOCS_PER_LANGUAGE training documents of each language (DOCS in all, and never more than twice that,
also where ids repeat), chosen by a hash; whole texts, of whose longer words the model learns from pieces of FIT_WORD
letters. Everything else covers all data.

Cases: null text, and text without a letter, is `und` with score 0. Letters that no piece has count as one
unknown letter. With no labelled document all is `und`. Columns named lang_pred or score are replaced by `identify`.
Equal rows are rows each; an empty table gives no rows. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "piece_bpe_32k.model"
FIT_WORD = 32
DOCS_PER_LANGUAGE, DOCS = 400, 20_000
ROUNDS, SMOOTHING = 4, 0.05
MEMO_WORDS, MEMO_LETTERS = 300_000, 48
LATTICE_LETTERS = 200_000
UND = "und"
WORD = re.compile(r"[^\W\d_]+")


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, in order of length and then of letters."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(filter(str.isalpha, found), key=lambda p: (len(p), p))


def letters(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case. What counts as a digit of some kind (², ½) parts them like any other sign."""
    out = []
    for w in WORD.findall((text or "").lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def parts(words: list[str]) -> list[str]:
    return [w[i : i + FIT_WORD] for w in words for i in range(0, len(w), FIT_WORD)]


class Lattice:
    """For many words, which piece each substring is. Pieces are numbered from 1 by length; 0 is none, the last the unknown letter."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary) + 2
        self.longest = max(map(len, vocabulary), default=1)
        self.keys, self.ids = [], []
        for n in range(1, self.longest + 1):
            at = [i + 1 for i, p in enumerate(vocabulary) if len(p) == n]
            key = self._hash(np.array([[ord(c) for c in vocabulary[i - 1]] for i in at], np.uint64).reshape(len(at), n))
            order = np.argsort(key)
            self.keys.append(key[order])
            self.ids.append(np.array(at, np.int32)[order])

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.zeros(len(codes), np.uint64)
            for k in range(codes.shape[1]):
                out = (out + codes[:, k] + np.uint64(1)) * self.BASE
            return out

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: their order by falling length, lengths, where their letters begin, and piece numbers (length, letter)."""
        length = np.array([len(w) for w in words])
        order = np.argsort(-length, kind="stable")
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        begin = np.cumsum(length) - length
        left = np.repeat(begin + length, length) - np.arange(len(codes))  # letters from here to the word's end
        ids = np.zeros((self.longest, len(codes)), np.int32)
        with np.errstate(over="ignore"):
            key = np.zeros(len(codes), np.uint64)
            for n in range(1, self.longest + 1):
                at = np.flatnonzero(left >= n)
                key[at] = (key[at] + codes[at + n - 1] + np.uint64(1)) * self.BASE
                if len(self.keys[n - 1]):
                    place = np.minimum(np.searchsorted(self.keys[n - 1], key[at]), len(self.keys[n - 1]) - 1)
                    ids[n - 1, at] = np.where(self.keys[n - 1][place] == key[at], self.ids[n - 1][place], 0)
        ids[0, ids[0] == 0] = self.size - 1
        return order, length[order], begin[order], ids


def forward(lattice: tuple, p: np.ndarray) -> np.ndarray:
    """alpha[word, j, language]: the probability of all ways to make the word's first j letters. Words in the lattice's order."""
    _, length, begin, ids = lattice
    alpha = np.zeros((len(length), int(length[0]) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, alpha.shape[1]):
        n = int(np.searchsorted(-length, -j, "right"))
        for k in range(1, min(j, len(ids)) + 1):
            piece = ids[k - 1, begin[:n] + j - k]
            hit = np.flatnonzero(piece)
            alpha[hit, j] += alpha[hit, j - k] * p[piece[hit]]
    return alpha


def log_forward(lattice: tuple, p: np.ndarray) -> np.ndarray:
    """The logarithm of all ways to make each word, by language, for words of any length. Words in the lattice's order."""
    _, length, begin, ids = lattice
    k_most = len(ids)
    ring = np.zeros((k_most, len(length), p.shape[1]))  # the last columns of alpha, each word's and language's divided by exp(scale)
    ring[0] = 1
    scale, out = np.zeros((len(length), p.shape[1])), np.zeros((len(length), p.shape[1]))
    n = len(length)
    for j in range(1, int(length[0]) + 1 if n else 0):
        ks = np.arange(1, min(j, k_most) + 1)
        if n > 8:
            new = np.zeros((n, p.shape[1]))
            for k in ks.tolist():
                piece = ids[k - 1, begin[:n] + j - k]
                hit = np.flatnonzero(piece)
                if len(hit) == n:
                    new += ring[(j - k) % k_most, :n] * p[piece]
                elif len(hit):
                    new[hit] += ring[(j - k) % k_most, hit] * p[piece[hit]]
        else:
            new = (ring[(j - ks) % k_most, :n] * p[ids[ks[:, None] - 1, begin[None, :n] + j - ks[:, None]]]).sum(0)
        ring[j % k_most, :n] = new
        on = int(np.searchsorted(-length, -(j + 1), "right"))
        out[on:n] = np.log(new[on:]) + scale[on:n]
        n = on
        if j % 8 == 0 and n:
            top = ring[:, :n].max(axis=0)
            ring[:, :n] /= top
            scale[:n] += np.log(top)
    return out


def expected(lattice: tuple, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected counts of each piece in each language, words weighing as given."""
    _, length, begin, ids = lattice
    alpha = forward(lattice, p)
    top = alpha.shape[1] - 1
    beta = np.zeros((len(length), top + 1 + len(ids), p.shape[1]))
    beta[np.arange(len(length)), length] = 1
    total = np.maximum(alpha[np.arange(len(length)), length], 1e-300)
    out = np.zeros_like(p)
    for j in range(top - 1, -1, -1):
        for k in range(1, min(len(ids), top - j) + 1):
            m = int(np.searchsorted(-length, -(j + k), "right"))
            piece = ids[k - 1, begin[:m] + j]
            hit = np.flatnonzero(piece)
            if not len(hit):
                continue
            piece = piece[hit]
            beta[hit, j] += beta[hit, j + k] * p[piece]
            share = alpha[hit, j] * p[piece] * beta[hit, j + k] / total[hit] * weight[hit]
            for lang in range(p.shape[1]):
                out[:, lang] += np.bincount(piece, share[:, lang], len(p))
    out[0] = 0
    return out


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    vocabulary: list[str]
    p: np.ndarray
    prior: np.ndarray


def fit(texts: list[tuple[str, str]], vocabulary: list[str], shares: dict[str, int]) -> Model:
    """A model from (language, text) pairs; shares has each language's number of training documents."""
    languages = tuple(sorted(shares))
    lattice = Lattice(vocabulary)
    counts = {lang: Counter() for lang in languages}
    for lang, text in texts:
        counts[lang].update(parts(letters(text)))
    words = sorted(set().union(*counts.values())) if languages else []
    p = np.full((lattice.size, len(languages)), 1.0 / lattice.size)
    p[0] = 0
    if words:
        weight = np.array([[counts[lang][w] for lang in languages] for w in words], float)
        blocks = []
        for i in range(0, len(words), 20_000):
            x = lattice.of(words[i : i + 20_000])
            blocks.append((x, weight[i : i + 20_000][x[0]]))
        for _ in range(ROUNDS):
            seen = sum(expected(x, p, w) for x, w in blocks) + SMOOTHING
            seen[0] = 0
            p = seen / seen.sum(axis=0)
    prior = np.log(np.array([shares[x] for x in languages], float) / max(1, sum(shares.values()))) if languages else np.zeros(0)
    return Model(languages, vocabulary, p, prior)


class Scorer:
    """Log probabilities of words under each language; words met before are remembered, up to MEMO_WORDS."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.vocabulary)
        self.known: dict[str, int] = {}
        self.logs = np.zeros((1024, len(model.languages)))

    def logs_of(self, words: list[str]) -> np.ndarray:
        """Log probabilities of distinct words, by language."""
        out, first = np.zeros((len(words), self.logs.shape[1])), 0
        ends = np.cumsum([len(w) for w in words])
        while first < len(words):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + LATTICE_LETTERS, "right")))
            x = self.lattice.of(words[first:last])
            out[first + x[0]] = log_forward(x, self.model.p)
            first = last
        return out

    def add(self, words: list[str]) -> None:
        at, need = len(self.known), len(self.known) + len(words)
        if need > len(self.logs):
            self.logs = np.concatenate([self.logs, np.zeros((max(need - len(self.logs), len(self.logs)), self.logs.shape[1]))])
        self.logs[at:need] = self.logs_of(words)
        self.known.update(zip(words, range(at, need), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.languages:
            return [(UND, 0.0)] * len(texts)
        words = [letters(t) for t in texts]
        if len(self.known) > MEMO_WORDS:
            self.known = {}
        known = self.known
        new = {w for ws in words for w in ws if w not in known}
        long = sorted(w for w in new if len(w) > MEMO_LETTERS)  # not remembered, so that the memo is bounded in bytes
        if new:
            self.add(sorted(new.difference(long)))
        apart = dict(zip(long, self.logs_of(long), strict=True))
        out = []
        for ws in words:
            if not ws:
                out.append((UND, 0.0))
                continue
            total = self.model.prior.copy()
            if apart:
                total += sum((apart[w] for w in ws if w in apart), np.zeros(len(total)))
                ws = [w for w in ws if w not in apart]
            total += self.logs[np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def bucket(doc_id: Column, n: int) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n


def train(docs: DataFrame, path: str) -> Model:
    """A model from the given labelled documents."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return Model((), pieces(path), np.zeros((0, 0)), np.zeros(0))
    bound = min(DOCS_PER_LANGUAGE, max(1, DOCS // len(shares)))
    span = 1 << 40
    limits = F.create_map(*[x for lang, n in shares.items() for x in (F.lit(lang), F.lit(min(span, span * bound // n)).cast("long"))])
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(span))
    chosen = labelled.filter(drawn < limits[F.col("lang")]).orderBy(drawn, F.xxhash64("text"), "lang").limit(2 * DOCS).select("lang", "text")
    return fit([tuple(r) for r in chosen.collect()], pieces(path), shares)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to the given columns; columns with such names go."""
    docs = docs.drop("lang_pred", "score")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                lang, score = zip(*scorer(some.column(place).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def language_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    held_out = bucket(F.col("doc_id"), 3) == 1
    model = train(docs.filter(~held_out), path or default_path())
    given = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(given, model).select("doc_id", "held_out", "lang_pred", "score")


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))
