"""A content-addressed store for token ids.

Documents in ascending order are encoded, each followed by an end id. The stream of ids is cut into chunks
where a rolling hash of the last ids says so, so equal passages give equal chunks wherever they stand. A chunk
is named by the SHA-256 of its bytes and stored once. A document's recipe lists its chunks; a manifest of the
recipes forms a Merkle tree of one leaf a document, whose root a reader verifies before it trusts the ids.

A store has
- a table of chunks (digest, n_ids, data), bucketed by digest: every distinct chunk once; data is Zstandard over
  little-endian ids of two bytes each where the vocabulary has at most 65,536 ids, else four; the digest is the
  SHA-256 of the bytes before compression
- recipes/  parquet (part, seq, doc, start, n_tokens, leaf, digests): one row a document, in order in each part
- manifest/ parquet (part, n_docs, n_tokens, root): one row a part; `store_root` combines the parts' roots

Chunks end at documents' ends, so a document is read from its recipe alone.

Cases: null text is empty and gives the end id alone. Rows that repeat are stored as rows each, their chunks
once. Texts of any length are encoded whole. An empty table gives an empty store. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartmill.llm.text import delete, shared_dir
from cartmill.llm.wordhash import powers

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: A chunk ends after an id where the rolling hash of the last WINDOW ids has CUT_BITS zero bits, and at MAX_IDS.
WINDOW, CUT_BITS, MIN_IDS, MAX_IDS = 16, 11, 256, 16_384
ROLL = 0xD1342543DE82EF95
MEMO_PIECES, LONGEST_KEY = 650_000, 48
IDS_PER_BUCKET, SLICE_BYTES = 16_000_000, 4 << 20

#: Characters that are neither letters, digits nor white space; an apostrophe or bracket opens other pre-tokens.
MARKS = ".,!?;:#*$%&"
#: White space of Unicode but space and line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")


class Memo(dict):
    """Remembers what `make` gives: up to `most` runs of letters, which are dear to make, and an eighth of that of other keys.

    Keys of more than LONGEST_KEY characters are made each time, so that what is held is bounded in bytes too.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.left, self.left_other = make, most, most // 8

    def __missing__(self, key: str) -> bytes:
        made = self.make(key)
        if len(key) > LONGEST_KEY:
            return made
        if key.isalpha():
            if self.left > 0:
                self.left -= 1
                self[key] = made
        elif self.left_other > 0:
            self.left_other -= 1
            self[key] = made
        return made


class Encoder:
    """Ids of whole texts, by the tokenizers library.

    A byte-level vocabulary never joins across a single space between two characters that are not white space:
    the space opens the next piece. So a text is cut there, and each distinct piece is put together from its
    pre-tokens, which the library encodes. Both are remembered; once a memo is full, further ones are encoded
    each time, which changes no result.
    """

    #: Fixed: the pre-tokens of this kind of vocabulary.
    PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def __init__(self, path: str, memo: int = MEMO_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model, self.spelled = self.tokenizer.model, self._spelling()
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the memos serve in its place
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pre = Memo(self._library, memo // 4)  # pre-tokens as they are
        self.whole = Memo(self._piece, memo // 4)  # pieces as they are
        self.spaced = Memo(self._spaced, memo)  # pieces without the space that opens them

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned integers of `width` bytes, without an end id."""
        out = [b""] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if t and self._loose(t):
                out[i] = b"".join(map(self.whole.__getitem__, self.pieces(t)))
            elif t:
                plain.append(i)
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """Of texts whose pieces but the first are opened by a space each: every distinct piece is looked up once for all of them."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds, words = np.asarray(cut.offsets), cut.flatten().dictionary_encode()
        made = [self.spaced[w] for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        index = words.indices.to_numpy().astype(np.int64)
        index[bounds[:-1]] = len(made) + np.arange(len(texts))
        made += [self.whole[t.split(" ", 1)[0]] for t in texts]
        n_ids = np.fromiter(map(len, made), np.int64, len(made)) // self.width
        starts = (np.cumsum(n_ids) - n_ids)[index]
        n_ids = n_ids[index]
        ends = np.cumsum(n_ids)
        ids = np.frombuffer(b"".join(made), f"<u{self.width}")
        raw = ids[np.repeat(starts - ends + n_ids, n_ids) + np.arange(ends[-1])].tobytes()
        at = self.width * np.concatenate([[0], ends])[bounds]
        return (raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def _spelling(self) -> dict[int, str]:
        """How the library spells letters and the space for its model, up to U+024F; empty unless the vocabulary is a plain byte-level one."""
        from tokenizers import pre_tokenizers

        step = self.tokenizer.pre_tokenizer
        if self.tokenizer.normalizer is not None or not isinstance(step, pre_tokenizers.ByteLevel) or step.add_prefix_space:
            return {}
        return {ord(c): step.pre_tokenize_str(c)[0][0] for c in map(chr, range(0x250)) if c == " " or c.isalpha()}

    def _spaced(self, rest: str) -> bytes:
        if rest.isalpha():  # with its space one pre-token, so the library's model takes it as it is
            if self.spelled and rest.isascii():
                return self._bytes([t.id for t in self.model.tokenize(self.spelled[32] + rest)])
            if self.spelled and max(rest) < "\u0250":
                return self._bytes([t.id for t in self.model.tokenize(self.spelled[32] + rest.translate(self.spelled))])
            return self._library(f" {rest}")
        letters = rest.rstrip(MARKS)
        if letters.isalpha():  # and the marks after it another
            return self.spaced[letters] + self.pre[rest[len(letters) :]]
        return self._piece(f" {rest}")

    def _piece(self, piece: str) -> bytes:
        if any(s in piece for s in self.special):
            return self._library(piece)
        return b"".join([self.spaced[x[1:]] if x[0] == " " and x[1:].isalpha() else self.pre[x] for x in self.PRE_TOKENS.findall(piece)])

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    @staticmethod
    def _loose(text: str) -> bool:
        """Whether white space may touch other white space or an end of the text, or is neither space nor line feed."""
        return "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] == " " or text[-1] == " " or OTHER_SPACE.search(text) is not None

    @staticmethod
    def pieces(text: str) -> list[str]:
        """A cut before each single space that stands between characters that are not white space."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts if text else []
        out, at, loose = [], parts[0], parts[0] == "" or parts[0][-1:].isspace()
        for part in parts[1:]:
            if loose or part == "" or part[0].isspace():
                at = f"{at} {part}"
            else:
                out.append(at)
                at = f" {part}"
            loose = part == "" or part[-1].isspace()
        out.append(at)
        return out


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks of an id stream end, by content. The last is the stream's end."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    with np.errstate(over="ignore"):
        weights = powers(ROLL, WINDOW)
        rolled, span = ids.astype(np.uint64) + np.uint64(1), 1
        while span < WINDOW:  # a polynomial over 2, 4, 8, ... ids
            rolled = rolled[:-span] + rolled[span:] * weights[span]
            span *= 2
    ends = np.flatnonzero((rolled >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW
    out, last = [], 0
    for e in [*ends[ends < n].tolist(), n]:
        while e - last > MAX_IDS:
            last += MAX_IDS
            out.append(last)
        if e == n or e - last >= MIN_IDS:
            if e > last:
                out.append(e)
            last = e
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a binary SHA-256 tree; an odd node moves up. No leaves: the hash of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        up = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2])]  # noqa: B905
        level = up + level[len(up) * 2 :]
    return level[0]


def leaf(doc: int | None, digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"\x00" + repr(doc).encode() + b"".join(digests)).digest()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary; its memo serves all tasks of the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, n_bytes: int) -> bytes:
    return pa.decompress(data, decompressed_size=n_bytes, codec="zstd", asbytes=True)


FRESH = pa.struct([("digest", pa.binary()), ("n_ids", pa.int64()), ("data", pa.binary())])
ENCODED = pa.schema([("doc", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("leaf", pa.binary()), ("fresh", pa.list_(FRESH))])
ENCODED_DDL = "doc long, n_tokens long, digests array<binary>, leaf binary, fresh array<struct<digest:binary,n_ids:long,data:binary>>"


def _slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in order, about `most` bytes of text at a time or one row with more."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        w = encode.width
        seen: set[bytes] = set()
        for batch in batches:
            for some in _slices(batch):
                docs, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                rows = []
                for doc, code in zip(docs, encode(texts), strict=True):
                    data = code + int(END_ID).to_bytes(w, "little")
                    digests, fresh, at = [], [], 0
                    for e in cuts(np.frombuffer(data, f"<u{w}")):
                        raw = data[w * at : w * e]
                        d = hashlib.sha256(raw).digest()
                        digests.append(d)
                        if d not in seen:
                            seen.add(d)
                            fresh.append({"digest": d, "n_ids": e - at, "data": pack(raw)})
                        at = e
                    rows.append((doc, len(data) // w, digests, leaf(doc, digests), fresh))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ENCODED, strict=True)], schema=ENCODED)
            if len(seen) > 200_000:
                seen.clear()

    return run


def write_store(docs: DataFrame, folder: str, chunks: str, path: str, doc: str = "doc_id", text: str = "text") -> None:
    """Writes a store of the documents, in ascending order of `doc` (nulls last): recipes and manifest under `folder`, chunks as a table."""
    spark = docs.sparkSession
    docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_encode(path), ENCODED_DDL).write.parquet(f"{folder}/encoded")
    encoded = spark.read.parquet(f"{folder}/encoded")
    n_ids = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    buckets = 1 << max(3, math.ceil(math.log2(max(1, n_ids) / IDS_PER_BUCKET)))
    fresh = encoded.select(F.explode("fresh").alias("c")).select("c.*").repartition(buckets, "digest")
    # equal digests meet in one task, one after the other once sorted
    last = Window.partitionBy("digest").orderBy("n_ids")
    once = fresh.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth")
    once.write.bucketBy(buckets, "digest").format("parquet").saveAsTable(chunks)
    light = encoded.select("doc", "n_tokens", "digests", "leaf")
    ranged = light.repartitionByRange(F.col("doc").asc_nulls_last()).sortWithinPartitions(F.col("doc").asc_nulls_last(), "leaf")
    ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(f"{folder}/sorted")
    delete(spark, f"{folder}/encoded")
    parts = spark.read.parquet(f"{folder}/sorted")
    sums = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    recipes = parts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums.select("part", "base"), "part")
    recipes.select("part", "seq", "doc", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "leaf", "digests").write.parquet(f"{folder}/recipes")
    roots = _roots(spark.read.parquet(f"{folder}/recipes"))
    roots.join(sums.select("part", "n_docs", F.col("n").alias("n_tokens")), "part").write.parquet(f"{folder}/manifest")
    delete(spark, f"{folder}/sorted")


def _roots(recipes: DataFrame) -> DataFrame:
    """part and the Merkle root over its documents' leaves, in order."""

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves = None, []
        for b in batches:
            for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if at is not None and part != at:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "root": pa.array([merkle(leaves)], pa.binary())})
                    leaves = []
                at = part
                leaves.append(x)
        if at is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "root": pa.array([merkle(leaves)], pa.binary())})

    return recipes.select("part", "seq", "leaf").repartition("part").sortWithinPartitions("part", "seq").select("part", "leaf").mapInArrow(root, "part int, root binary")


def store_root(spark: SparkSession, folder: str) -> bytes:
    """The root over the parts' roots: one small row a part."""
    return merkle([bytes(r["root"]) for r in spark.read.parquet(f"{folder}/manifest").orderBy("part").select("root").toLocalIterator()])


def read_store(spark: SparkSession, folder: str, chunks: str) -> DataFrame:
    """doc, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, put together and verified.

    Each chunk is checked against its name. A part whose recipes don't give the manifest's root, and a
    document with a chunk missing or damaged, raise an error.
    """
    recipes = spark.read.parquet(f"{folder}/recipes")
    said = spark.read.parquet(f"{folder}/manifest").withColumnRenamed("root", "said")
    if said.join(_roots(recipes), "part", "full").filter(~F.col("said").eqNullSafe(F.col("root"))).limit(1).count():
        raise ValueError("a part's recipes don't match the manifest")
    needs = recipes.select("part", "seq", F.posexplode("digests").alias("k", "digest"))
    got = needs.join(spark.table(chunks), "digest", "left").groupBy("part", "seq").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "n_ids", "data"))).alias("pieces"))
    rows = recipes.select("part", "seq", "doc", "start", "n_tokens").join(got, ["part", "seq"], "left").select("doc", "start", "n_tokens", "pieces")
    return rows.mapInArrow(_put_together, "doc long, start long, n_tokens long, ids binary")


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 128):
            rows = batch.slice(i, 128)
            ids = [_joined(pieces or [], n) for pieces, n in zip(rows.column(3).to_pylist(), rows.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(ids, pa.binary())], ["doc", "start", "n_tokens", "ids"])


def _joined(pieces: list[dict], n_tokens: int) -> bytes:
    out = []
    for p in pieces:
        if p["data"] is None:
            raise ValueError("a chunk is missing")
        for width in (2, 4):
            try:
                raw = unpack(p["data"], width * p["n_ids"])
            except (OSError, ValueError):
                continue
            if hashlib.sha256(raw).digest() == p["digest"]:
                out.append(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes())
                break
        else:
            raise ValueError("a chunk doesn't match its name")
    ids = b"".join(out)
    if len(ids) != 4 * n_tokens:
        raise ValueError("a document's chunks don't add up to its ids")
    return ids


def store_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from a store that is written and read back."""
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path(VOCABULARY))
    name = f"idstore_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    write_store(docs, folder, name, path)
    return read_store(spark, folder, name).select(F.col("doc").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
