"""All links of Jaccard similarity 0.8 or more between documents' sets of word shingles, by adaptive multi-match prefixes.

Classes. Documents with equal sets form a class, known by the set's 64-bit signature; only classes are joined.

Prefixes (after Wang, Li and Feng, 2012). All shingles have one order, rare ones first. Two sets that link share
`ell` shingles among the first n - ceil(0.8 n) + ell of each, for any ell. Each set takes the ell of least
estimated cost: a longer prefix reads more postings but asks candidates for more shared shingles. A pair is a
candidate if its prefixes share as many as the smaller of the two ells. Frequencies are counted over all classes, in
slots of a hash table with SLOTS places a shingle: what shares a slot looks a little more frequent than it is, never
less, and any order gives all links. A shingle counted once is in one class only, so it has no posting.

Links. In each posting list all sets are first compared with the list's least and greatest one, and what links
is put together. Only pairs that share a list and are still apart are candidates then, so that a group of many
near copies costs about as many pairs as it has members, not their square; no pair that could link groups is
left out. Of those, sets of unlike sizes never meet, as lists are cut into bands by size, and a pair is dropped at
once if 1024 bits of the two sets' parities show that they can't link: where a bit is the parity of the shingles
that hash to it, the bits that differ are at most the shingles that one set alone has, and two sets of m and n
shingles that link have at most (m + n) / 9 of those. Candidates are verified exactly, on whole sets that
workers map into memory.

Result: component_id is the least doc_id reachable over links (doc_id of any type that has an order). Cases: null and blank texts have empty sets and are linked
with nothing. A text of fewer than five words is one shingle. Equal rows are rows each. An empty table gives
no rows. Only doc_id and text are read. A null doc_id never names a component that has another doc_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartmill.llm.hasharrays import ROWS, by_bucket, deal, find, mapped, pack, rows, smallest, split, store, unpack
from cartmill.llm.text import scratch
from cartmill.llm.wordhash import BASE, chunks, mix64, shingles
from cartmill.operators.graph import components

#: Places of the table of frequencies for each shingle of the documents, and the least that it has.
SLOTS, LEAST_SLOTS = 4, 1 << 16
#: Words of 64 parity bits, and the ratio of sizes that makes a band: more than that of sets that link.
MAPS, BAND = 16, 1.26
#: The longest ell tried, and the cost of a verification in postings read.
ELLS, VERIFY_COST = 16, 40
PERCENT = 80
SHINGLES_PER_BUCKET = 4_000_000


def needed(n: np.ndarray) -> np.ndarray:
    """The least overlap with any set that a set of n shingles can link to."""
    return (n * PERCENT + 99) // 100


def sets(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Batch number, row, sorted set and signature of each document with words."""
    for i, batch in enumerate(batches):
        for w in chunks(batch.column(place)):
            every, counts = shingles(w)
            ends = np.cumsum(counts)
            for k in np.flatnonzero(counts).tolist():
                own = np.unique(every[ends[k] - counts[k] : ends[k]])
                with np.errstate(over="ignore"):
                    sig = mix64(np.array([mix64(own).sum(dtype=np.uint64) * np.uint64(2) + np.uint64(len(own))], np.uint64)).view(np.int64)[0]
                yield i, w.first + k, own, int(sig)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sig = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for _, row, own, s in sets(iter([batch]), 1):
            n[row], sig[row] = len(own), s
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sig, pa.int64(), mask=n == 0)], ["doc_id", "n_shingles", "sig"])


@dataclass(frozen=True)
class Slots:
    """A table of 2**bits slots in 2**bucket_bits buckets."""

    bits: int
    bucket_bits: int

    @classmethod
    def for_shingles(cls, total: int) -> Slots:
        bits = math.ceil(math.log2(max(LEAST_SLOTS, SLOTS * total)))
        return cls(bits, max(3, math.ceil(math.log2(max(1, total) / SHINGLES_PER_BUCKET))))

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each shingle, and its slot there."""
        slot = mix64(key ^ np.uint64(BASE)) >> np.uint64(64 - self.bits)
        inside = np.uint64(self.bits - self.bucket_bits)
        return (slot >> inside).astype(np.int64), slot & np.uint64((1 << int(inside)) - 1)


def _counted(slots: Slots):
    """The slots of all classes' shingles, packed by bucket as differences; a task sends a class once."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        bucket, slot = slots.of(np.concatenate(held))
        found = []
        for b, i in split(bucket):
            found.append((b, pack([smallest(np.diff(np.sort(slot[i]), prepend=np.uint64(0)))])))
        return rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for _, _, own, sig in sets(batches, 0):
            if sig not in seen:
                seen.add(sig)
                held.append(own)
                size += len(own)
                if size >= 2_000_000:
                    yield packed(held)
                    held, size = [], 0
            if len(seen) > 500_000:
                seen.clear()
        if size:
            yield packed(held)

    return run


def _frequent(folder: str):
    """Stores the slots that were met twice or more, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in by_bucket(batches):
            every = [np.cumsum(unpack(x)[0].astype(np.uint64), dtype=np.uint64) for x in held]
            key, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            keep = count > 1
            store(folder, f"frequent-{b}", [key[keep].astype(np.uint32), smallest(count[keep])])
            yield rows([(b, b"")])

    return run


class Frequencies:
    """How many sets have a shingle, at least: 0 where that is one."""

    def __init__(self, folder: str, slots: Slots):
        self.folder, self.slots, self.files = folder, slots, {}

    def __call__(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        bucket, slot = self.slots.of(key)
        for b, at in split(bucket):
            if b not in self.files:
                self.files[b] = mapped(self.folder, f"frequent-{b}")
            place, known = find(self.files[b][0], slot[at].astype(np.uint32))
            out[at[known]] = self.files[b][1][place].astype(np.int64)
        return out


def prefix(own: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, int]:
    """The prefix of a set, without what no other set has, and its ell."""
    order = np.lexsort((own, frequency))
    n = len(own)
    least = int(needed(np.int64(n)))
    ells = np.arange(1, min(ELLS, least) + 1)
    read = np.cumsum(np.maximum(frequency[order] - 1, 0))[n - least + ells - 1]
    cost = read + (n - least + ells) + VERIFY_COST * read / ells
    ell = int(ells[np.argmin(cost)])
    first = order[: n - least + ell]
    return own[first[frequency[first] > 0]], ell


def _postings(folder: str, slots: Slots, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        estimate, seen = Frequencies(folder, slots), set()
        group, size, held, facts, posted = [], 0, [], [], 0

        def prefixes() -> None:
            nonlocal posted
            every = estimate(np.concatenate([own for own, _ in group]))
            at = 0
            for own, sig in group:
                first, ell = prefix(own, every[at : at + len(own)])
                at += len(own)
                if not len(first):
                    continue
                held.append(first)
                facts.append((sig, len(own), ell, len(first)))
                posted += len(first)

        def flush() -> pa.RecordBatch:
            sig, size, ell, length = (np.array(x, np.int64) for x in zip(*facts, strict=True))
            index = np.repeat(np.arange(len(sig)), length)
            key = np.concatenate(held)
            found = []
            for b, i in split((mix64(key) % np.uint64(n)).astype(np.int64)):
                own, where = np.unique(index[i], return_inverse=True)
                found.append((b, pack([key[i], smallest(where), sig[own].view(np.uint64), smallest(size[own]), smallest(ell[own])])))
            return rows(found)

        for _, _, own, sig in sets(batches, 0):
            if sig in seen:
                continue
            seen.add(sig)
            group.append((own, sig))
            size += len(own)
            if size >= 200_000:
                prefixes()
                group, size = [], 0
            if posted >= 1_000_000:
                yield flush()
                held, facts, posted = [], [], 0
            if len(seen) > 500_000:
                seen.clear()
        if group:
            prefixes()
        if held:
            yield flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the shingles that two classes or more have in their prefixes."""
    for _, held in by_bucket(batches):
        if not held:
            continue
        key, sig, size, ell = [], [], [], []
        for x in held:
            k, where, s, n, e = unpack(x)
            where = where.astype(np.int64)
            key.append(k)
            sig.append(s[where])
            size.append(n[where].astype(np.int64))
            ell.append(e[where].astype(np.int64))
        key, sig, size, ell = (np.concatenate(x) for x in (key, sig, size, ell))
        order = np.lexsort((sig, key))
        key, sig, size, ell = key[order], sig[order], size[order], ell[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
        key, sig, size, ell = key[fresh], sig[fresh], size[fresh], ell[fresh]
        twin = np.concatenate([[False], key[1:] == key[:-1]])
        keep = twin | np.concatenate([twin[1:], [False]])
        for i in range(0, int(keep.sum()), 100_000):
            at = np.flatnonzero(keep)[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[at].view(np.int64)), pa.array(sig[at].view(np.int64)), pa.array(size[at]), pa.array(ell[at])], ["shingle", "sig", "n", "ell"])


def _whole_sets(folder: str, wanted: int, n: int):
    """Whole sets of the classes in the files wanted-*, for their buckets; a task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SetFiles(folder, "wanted", wanted)
        seen, held, size = set(), {}, 0

        def flush() -> pa.RecordBatch:
            sig = np.array(list(held), np.int64).view(np.uint64)
            own = list(held.values())
            return rows([(b, pack([sig[i], smallest(np.array([len(own[k]) for k in i])), np.concatenate([own[k] for k in i])])) for b, i in split(bucket_of(sig, n))])

        for _, _, own, sig in sets(batches, 0):
            if sig not in seen:
                seen.add(sig)
                if lists.has(sig):
                    held[sig] = own
                    size += len(own)
                    if size >= 1_000_000:
                        yield flush()
                        held, size = {}, 0
            if len(seen) > 500_000:
                seen.clear()
        if held:
            yield flush()

    return run


def bucket_of(sig: np.ndarray, n: int) -> np.ndarray:
    return (mix64(sig) % np.uint64(n)).astype(np.int64)


def _store_sets(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in by_bucket(batches):
            found = {}
            for x in held:
                sig, length, every = unpack(x)
                ends = np.cumsum(length.astype(np.int64))
                for k, s in enumerate(sig.tolist()):
                    found.setdefault(s, every[ends[k] - int(length[k]) : ends[k]])
            sig = np.array(sorted(found), np.uint64)
            ends = np.cumsum([len(found[s]) for s in sig.tolist()])
            store(folder, f"sets-{b}", [sig, np.array(ends, np.uint64), np.concatenate([np.zeros(0, np.uint64), *(found[s] for s in sig.tolist())])])
            yield rows([(b, b"")])

    return run


def _store_wanted(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, held in by_bucket(batches):
            store(folder, f"wanted-{b}", [np.unique(np.array(held, np.int64).view(np.uint64))])
            yield rows([(b, b"")])

    return run


class SetFiles:
    """Files of signatures, and of sets, by bucket; mapped when first needed."""

    def __init__(self, folder: str, name: str, n: int):
        self.folder, self.name, self.n, self.files = folder, name, n, {}

    def _file(self, sig: int) -> tuple[list[np.ndarray], int] | None:
        key = np.array([sig], np.int64).view(np.uint64)
        b = int(bucket_of(key, self.n)[0])
        if b not in self.files:
            self.files[b] = mapped(self.folder, f"{self.name}-{b}")
        got = self.files[b]
        i = int(np.searchsorted(got[0], key[0]))
        return (got, i) if i < len(got[0]) and got[0][i] == key[0] else None

    def has(self, sig: int) -> bool:
        return self._file(sig) is not None

    def set(self, sig: int) -> np.ndarray:
        got, i = self._file(sig)
        return got[2][int(got[1][i - 1]) if i else 0 : int(got[1][i])]


def _verify(folder: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SetFiles(folder, "sets", n)
        last, one = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if x != last:
                    last, one = x, files.set(x)
                other = files.set(y)
                low, high = (one, other) if len(one) < len(other) else (other, one)
                place = np.minimum(np.searchsorted(high, low), len(high) - 1)
                both = int(np.count_nonzero(high[place] == low))
                if 100 * both >= PERCENT * (len(low) + len(high) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return run


def _maps(folder: str, n: int):
    """The parity bits of each signature's set, in MAPS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = SetFiles(folder, "sets", n)
        for batch in batches:
            bits = np.zeros((len(batch), 64 * MAPS), np.uint8)
            for i, sig in enumerate(batch.column(0).to_pylist()):
                place = (mix64(files.set(sig)) >> np.uint64(32)) % np.uint64(64 * MAPS)
                bits[i] = np.bincount(place.astype(np.int64), minlength=64 * MAPS) & 1
            words = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.int64).T)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, words)], ["sig", *(f"m{k}" for k in range(MAPS))])

    return run


def may_link(m: Column, n: Column) -> Column:
    """Whether sets of m and n shingles can be similar enough."""
    return 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, sig (null if empty) and component_id of every document."""
    spark = docs.sparkSession
    folder = scratch(spark, "ngramjoin")
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(f"{path}/frequent")
    kept = lambda df, name: df.write.parquet(f"{folder}/{name}") or spark.read.parquet(f"{folder}/{name}")
    texts, id_type = docs.select(text), docs.select(doc).schema[0].dataType.simpleString()
    all_sets = kept(docs.select(F.col(doc).alias("doc_id"), text).mapInArrow(_signatures, f"doc_id {id_type}, n_shingles long, sig long"), "signatures")
    total = all_sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n, slots = max(8, math.ceil(total / SHINGLES_PER_BUCKET)), Slots.for_shingles(total)
    deal(texts.mapInArrow(_counted(slots), ROWS), 1 << slots.bucket_bits).mapInArrow(_frequent(f"{folder}/frequent"), ROWS).count()
    shared = kept(deal(texts.mapInArrow(_postings(f"{folder}/frequent", slots, n), ROWS), n).mapInArrow(_shared, "shingle long, sig long, n long, ell long"), "shared")
    system.delete_dir(f"{path}/frequent")
    n_sets = 2 * n
    _keep_sets(spark, texts, shared, folder, n_sets)

    # each list's sets against its least and its greatest one
    links = kept(_linked(_against(shared, F.col("sig")), folder, n_sets), "links")
    # then, in lists whose sets are still apart, against two others, which differ from list to list
    mixed = _mixed(shared, components(links, f"{folder}/first"))
    again = _against(mixed, F.xxhash64("sig", "shingle"), across=True)
    links = kept(links.unionByName(_linked(again, folder, n_sets)), "links-again")

    # what still is apart
    apart = kept(_mixed(shared, components(links, f"{folder}/again")), "apart")
    maps = apart.select("sig").distinct().mapInArrow(_maps(folder, n_sets), ", ".join(["sig long", *(f"m{k} long" for k in range(MAPS))]))
    late = kept(_linked(_met(apart.join(kept(maps, "maps"), "sig")), folder, n_sets), "late")
    roots = components(links.unionByName(late), f"{folder}/second").withColumnRenamed("node", "sig")

    classes = all_sets.filter("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first")).join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    named = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    names = classes.join(named, "root").select("sig", "component_id")
    return all_sets.join(names, "sig", "left").select("doc_id", "n_shingles", "sig", F.coalesce("component_id", "doc_id").alias("component_id"))


def _met(apart: DataFrame) -> DataFrame:
    """Candidates a < b of different roots: pairs that share as many listed shingles as the smaller ell, and may link by size and parity."""
    band = F.floor(F.log(F.col("n")) / math.log(BAND))
    two = apart.withColumn("band", band).alias("two")
    one = apart.withColumn("band", band).withColumn("key", F.explode(F.array("band", F.col("band") + 1))).alias("one")
    differ = sum((F.bit_count(F.col(f"one.m{k}").bitwiseXOR(F.col(f"two.m{k}"))) for k in range(1, MAPS)), F.bit_count(F.col("one.m0").bitwiseXOR(F.col("two.m0"))))
    once = (F.col("one.band") < F.col("two.band")) | (F.col("one.sig") < F.col("two.sig"))
    meets = (F.col("one.shingle") == F.col("two.shingle")) & (F.col("one.key") == F.col("two.band")) & once & (F.col("one.root") != F.col("two.root"))
    m, n = F.col("one.n"), F.col("two.n")
    meets = meets & may_link(m, n) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (m + n))
    pair = [F.least("one.sig", "two.sig").alias("a"), F.greatest("one.sig", "two.sig").alias("b")]
    met = one.join(two, meets).groupBy(*pair).agg(F.count("*").alias("both"), F.min(F.least("one.ell", "two.ell")).alias("ell"))
    return met.filter("both >= ell").select("a", "b")


def _against(lists: DataFrame, order: Column, across: bool = False) -> DataFrame:
    """Distinct pairs a < b of each list's sets with those of least and greatest order there; only of different roots if asked."""
    facts = F.struct(*lists.columns[1:])
    ends = lists.groupBy("shingle").agg(F.min_by(facts, order).alias("lo"), F.max_by(facts, order).alias("hi"))
    pairs = lists.join(ends, "shingle").select(*lists.columns[1:], F.explode(F.array("lo", "hi")).alias("end"))
    pairs = pairs.filter((F.col("sig") != F.col("end.sig")) & may_link(F.col("n"), F.col("end.n")))
    if across:
        pairs = pairs.filter(F.col("root") != F.col("end.root"))
    return pairs.select(F.least("sig", "end.sig").alias("a"), F.greatest("sig", "end.sig").alias("b")).distinct()


def _mixed(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """shingle, sig, n, ell, root of the lists whose sets aren't all of one root."""
    grouped = shared.join(groups.withColumnRenamed("node", "sig"), "sig", "left").select("shingle", "sig", "n", "ell", F.coalesce("root", "sig").alias("root"))
    apart = grouped.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("shingle")
    return grouped.join(apart, "shingle", "left_semi")


def _keep_sets(spark: SparkSession, texts: DataFrame, shared: DataFrame, folder: str, n: int) -> None:
    """Stores the whole sets of all classes that have a shared posting."""

    @F.pandas_udf("int")
    def bucket(sig):
        import pandas as pd

        return pd.Series(bucket_of(sig.to_numpy(np.int64).view(np.uint64), n).astype(np.int32))

    wanted = shared.select("sig").distinct().withColumn("bucket", bucket("sig")).select("bucket", "sig")
    deal(wanted, n).mapInArrow(_store_wanted(folder), ROWS).count()
    deal(texts.mapInArrow(_whole_sets(folder, n, n), ROWS), n).mapInArrow(_store_sets(folder), ROWS).count()


def _linked(pairs: DataFrame, folder: str, n: int) -> DataFrame:
    """Those pairs that link. Pairs are dealt by both members, then sorted, so that equal first members are read once."""
    return pairs.repartition("a", "b").sortWithinPartitions("a").mapInArrow(_verify(folder, n), "a long, b long")


def join_report(docs: DataFrame) -> DataFrame:
    return join(docs).select("doc_id", "n_shingles", "component_id")
