"""Sorted hash arrays in files of the shared folder, and the packed arrays that tasks send each other.

A shuffle row is a bucket and packed arrays. A bucket's task merges what it gets and may store a file, which
workers map into memory: straight from a file system that they share, else from a copy that is unlinked as
soon as it is mapped, so that nothing stays behind.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smallest(a: np.ndarray) -> np.ndarray:
    """The array in the smallest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def to_bytes(columns: list[np.ndarray]) -> bytes:
    """A header of lengths and item sizes, then the arrays, each padded to eight bytes."""
    head = np.array([len(columns), *(x for c in columns for x in (len(c), c.itemsize))], np.uint64)
    parts = [head.tobytes()]
    for c in columns:
        raw = np.ascontiguousarray(c).tobytes()
        parts += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(parts)


def from_buffer(data) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    head = np.frombuffer(data, np.uint64, 2 * n, 8).reshape(n, 2).astype(np.int64)
    out, at = [], 8 * (1 + 2 * n)
    for length, item in head.tolist():
        out.append(np.frombuffer(data, f"<u{item}", length, at))
        at += -(-length * item // 8) * 8
    return out


def pack(columns: list[np.ndarray]) -> bytes:
    raw = to_bytes(columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    return from_buffer(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


def store(folder: str, name: str, columns: list[np.ndarray]) -> None:
    """Writes a file of arrays, whole or not at all. A task that runs twice gives the same file: the first that is there stays."""
    system, path = pafs.FileSystem.from_uri(folder)
    part = f"{path}/{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(to_bytes(columns))
    try:
        system.move(part, f"{path}/{name}")
    except OSError:  # some file systems don't move onto a name that is there
        if system.get_file_info(f"{path}/{name}").type != pafs.FileType.File:
            raise
        system.delete_file(part)


def mapped(folder: str, name: str) -> list[np.ndarray]:
    """A file's arrays, mapped into memory."""
    system, path = pafs.FileSystem.from_uri(folder)
    if isinstance(system, pafs.LocalFileSystem):
        return from_buffer(np.memmap(f"{path}/{name}", np.uint8, "r"))
    with tempfile.NamedTemporaryFile() as own:  # unlinked once mapped
        with system.open_input_stream(f"{path}/{name}") as given:
            while got := given.read(1 << 24):
                own.write(got)
        own.flush()
        return from_buffer(np.memmap(own.name, np.uint8, "r"))


def summed(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and, of each value array, the sums by key."""
    if not len(key):
        return [key, *(np.zeros(0, np.uint64) for _ in values)]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return [key[first], *(np.add.reduceat(v[order].astype(np.uint64), first) for v in values)]


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, and the places of its items."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    for b, part in zip(held[first].tolist(), np.split(order, first[1:]), strict=True):
        yield b, part


def rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], ["bucket", "data"])


ROWS = "bucket int, data binary"


def deal(df: DataFrame, n: int) -> DataFrame:
    """Each bucket's rows to one task, bucket after bucket. Every bucket has a row, if only one without data, so that each gets its file."""
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"), F.lit(None).cast(df.schema[1].dataType).alias(df.columns[1]))
    return df.unionByName(every).repartition(n, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """What rows that are sorted by bucket hold, bucket by bucket; nothing of rows without data."""
    at, held = None, []
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at is not None and b != at:
                yield at, held
                held = []
            at = b
            if x is not None:
                held.append(x)
    if at is not None:
        yield at, held


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of those keys that are there, and which those are. Keys are looked up in order, so that reads go forward."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    place = np.minimum(np.searchsorted(sorted_keys, keys[order]), len(sorted_keys) - 1)
    hit = sorted_keys[place] == keys[order]
    return place[hit], order[hit]
