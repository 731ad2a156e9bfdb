"""Words of Arrow text columns as 64-bit hashes, without a Python object for any word.

A text column's UTF-8 bytes are read in place. The hash of a word of up to LONG bytes is a polynomial in its bytes
modulo 2**64, got from one running sum over the batch, and then mixed. Such a polynomial is 0 for some long
sequences whatever its base (differences in Thue-Morse order, from 1024 bytes on), so longer words are hashed
by BLAKE2b instead. Equal words have equal hashes in every batch and on every machine. The chance that two of n
different words collide is about n*n / 2**65.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES, LONG = 1 << 20, 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        with np.errstate(over="ignore"):
            step = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            step[0] = 1
            got = _powers[base] = np.multiply.accumulate(step)
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Hashes of the words of documents first .. first + n_docs - 1 of a batch; counts has the words of each."""

    first: int
    n_docs: int
    hashes: np.ndarray
    counts: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin (one more than rows). A null has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """The column's words, some documents at a time; a document is never cut."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        yield _hash(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], first)
        first = last


def _hash(raw: np.ndarray, at: np.ndarray, first: int) -> Words:
    n = len(raw)
    if not n:
        return Words(first, len(at) - 1, np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64))
    space = _SPACE[raw]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < n]] = True  # a document begins
    starts = np.flatnonzero(~space & before)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends_at = at[1:]
    after[ends_at[ends_at > 0] - 1] = True  # a document ends
    ends = np.flatnonzero(~space & after) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
        h = mix64((sums[ends] - sums[starts]) * powers(INVERSE, n)[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(_LOWER[raw[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    return Words(first, len(at) - 1, h, np.diff(np.searchsorted(starts, at)))


def shingles(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's windows of `size` words, repeats included, and how many each has.

    A document with fewer words, but at least one, has its whole sequence as its one window.
    """
    h, counts = w.hashes, w.counts
    ends = np.cumsum(counts)
    n_windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if not len(h):
        return h, n_windows
    with np.errstate(over="ignore"):
        salts = [np.uint64(pow(BASE, k + 2, 1 << 64)) for k in range(size)]
        padded = np.concatenate([h, np.zeros(size - 1, np.uint64)])
        window = mix64(sum(padded[k : k + len(h)] * salts[k] for k in range(size)))
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - np.repeat(ends - counts, counts)
        keep = place < n_windows[doc]
        out = window[keep]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            where = np.cumsum(n_windows)[short] - 1
            for row, i in zip(where, short, strict=True):
                own = h[ends[i] - counts[i] : ends[i]]
                total = np.uint64(0)
                for k, x in enumerate(own):
                    total = total + x * salts[k]
                out[row] = mix64(np.array([total + np.uint64(counts[i])], np.uint64))[0]
    return out, n_windows
