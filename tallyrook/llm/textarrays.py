"""Whole texts as NumPy arrays inside Arrow tasks: words, word hashes and shingles of many documents at once.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled as UTF-8 bytes; A-Z can be lower-cased.
A null text has no words. Texts are taken in chunks of about CHUNK bytes (a longer text is a chunk of its own), so a
task needs memory for one chunk, or for its longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NEAR = 64
#: A random number for each byte at each of the first places of a span; later places are mixed from the last row's.
_PLACE_VALUE = np.random.default_rng(20240608).integers(0, 2**64, _NEAR * 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
#: The Mersenne prime of modular_*() and the base of its powers.
PRIME, _BASE = 2**61 - 1, 0x0B4E1A5C3D2F7961


def _start(n: int) -> np.uint64:
    """What the hash of n words begins with."""
    return np.uint64(n * int(_STEP) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of x."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK + CHUNK // 4)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 2**64))):
            x = np.full(n, np.uint64(base))
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array as (bytes, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A long column as (values, is null)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(column.is_null())


def release() -> None:
    """Give freed memory back to the system: a Python worker is used again, by stages that need it for something else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """f, which gives back what it has freed after each group."""

    def run(table: pa.Table) -> pa.Table:
        out = f(table)
        release()
        return out

    return run


@dataclass
class Chunk:
    """Documents first .. first + len(offsets) - 2 of a batch: their bytes, one behind the other, and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    data, offsets = byte_column(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        b = min(b, n, a + 60_000)
        yield Chunk(a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b
    release()


@dataclass
class Words:
    """Words of a chunk: byte ranges, document of each, and first[d]: the first word of document d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(c: Chunk) -> Words:
    n, docs = len(c.data), len(c)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(docs + 1, np.int64))
    ink = ~_SPACE[c.data]
    edge = np.zeros(n + 1, bool)
    edge[c.offsets] = True  # no word crosses from one text into the next
    starts, ends = ink.copy(), ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:n]
    ends[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, c.offsets)
    return Words(start, end, np.repeat(np.arange(docs), np.diff(first)), first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte ranges: sums of a random number for each pair of byte and place in its range.

    No pattern of bytes makes such sums agree, of any length; two different ranges do so by chance, once in 2**64.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    last = np.cumsum(size)
    place = np.arange(int(last[-1])) - np.repeat(last - size, size)
    byte = (_LOWER if lower else _SAME)[data[np.repeat(start, size) + place]]
    value = _PLACE_VALUE[np.minimum(place, _NEAR - 1) << 8 | byte]
    far = np.flatnonzero(place >= _NEAR - 1)
    value[far] = mix(value[far] + place[far].astype(np.uint64) * _STEP)
    total = np.empty(len(value) + 1, np.uint64)
    total[0] = 0
    np.cumsum(value, out=total[1:])
    return mix(total[last] - total[last - size] + size.astype(np.uint64) * _STEP)


def rolling_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Like span_hashes() for ranges that overlap, at a cost that follows the data: for choosing and grouping alone, since
    long ranges of a certain pattern (Thue-Morse) agree whatever their bytes; who needs equal bytes compares them."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """rolling_hashes() of the k bytes at each place of data."""
    n = len(data) - k + 1
    up, down = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    each = _BYTE_VALUE[data]
    each *= up[: len(data)]
    np.cumsum(each, out=total[1:])
    out = total[k:] - total[:n]
    out *= down[:n]
    out += np.array([k], np.uint64) * _STEP
    return mix(out)


def modular_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it: by halves, as 2**61 is 1."""
    half, low = np.uint64(31), np.uint64(2**31 - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return modular_rest((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64(2**30 - 1)) << half) + a0 * b0)


def modular_rest(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(PRIME), x - np.uint64(PRIME), x)


def modular_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo PRIME, of a fixed base and of its inverse."""
    if len(_powers.get("modular", ())) < n:
        for name, base in (("modular", _BASE), ("inverse", pow(_BASE, -1, PRIME))):
            x = np.ones(1, np.uint64)
            while len(x) < n:
                x = np.concatenate([x, modular_product(x, np.full(len(x), pow(base, len(x), PRIME), np.uint64))])
            _powers[name] = x
    return _powers["modular"][:n], _powers["inverse"][:n]


def modular_sums(value: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... numbers below PRIME, modulo it; their halves add up without overflow."""
    out = np.zeros(len(value) + 1, np.uint64)
    high, low = np.cumsum(value >> np.uint64(32)), np.cumsum(value & np.uint64(2**32 - 1))
    out[1:] = modular_rest(modular_product(modular_rest(high), np.full(len(high), 2**32, np.uint64)) + modular_rest(low))
    return out


def run_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n words on end; the last n - 1 starts are left out."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, _start(n))
    for j in range(n):
        out = out * np.uint64(_ODD) + word_hash[j : j + m]
    return mix(out)


def shingle_rows(w: Words, word_hash: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every n-word shingle in order; a shorter text has its whole word sequence as its only one."""
    runs = run_hashes(word_hash, n)
    keep = w.doc[: len(runs)] == w.doc[n - 1 : n - 1 + len(runs)]
    doc, value = w.doc[: len(runs)][keep], runs[keep]
    count = w.counts()
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            at = w.first[short]
            h = np.full(len(short), _start(m))
            for j in range(m):
                h = h * np.uint64(_ODD) + word_hash[at + j]
            doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(h)])
    return doc, value


def distinct_rows(doc: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, value), by doc and value, with the first row of each document."""
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16), kind="stable")]
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return doc, value, np.searchsorted(doc, np.arange(docs + 1))


def shingle_sets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of lower-cased n-word shingles of each document of a chunk: see distinct_rows()."""
    w = words(c)
    doc, value = shingle_rows(w, span_hashes(c.data, w.start, w.end, True), n)
    return distinct_rows(doc, value, len(c))


def segments(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (length[0] of them), first[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
    return np.arange(total) + skip


def total_bytes(documents, column: str = "text") -> int:
    """Bytes of all texts, from one aggregate: what bucket counts follow."""
    from pyspark.sql import functions as F

    return int(documents.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def bucket_bits(bytes_in: int, per_bucket: int) -> int:
    """So many leading bits of a hash that each of the buckets stands for about per_bucket bytes of text."""
    return max(3, int(np.ceil(np.log2(max(1, bytes_in / per_bucket)))))
