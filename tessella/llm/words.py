"""Vectorised byte-level tokenising and hashing of Arrow string columns.

Every word rule used by the corpus operators is a set of separator *bytes*
below 0x80, and UTF-8 never uses such bytes inside a longer character, so
words can be cut on the raw buffer without decoding it.  Work goes slice by
slice (``slices``), so memory follows the slice and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes whose running polynomial is held at once while hashing.
HASH_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over bytes, true inside the inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Separators of ``[^\x20\x09-\x0D]+`` and of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACES = byte_table((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE_CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (multiply, shift, xor)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get(seed)
    if held is None or len(held[0]) < n:
        size = max(n, HASH_BYTES + 4096)
        base = _BASES[seed]
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        held = _powers[seed] = (tables[0], tables[1])
    return held


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of every byte span; spans are sorted and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i, n = 0, len(starts)
    codes = _BYTE_CODES[seed]
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + HASH_BYTES, "right")))
        high = int(ends[j - 1])
        power, inverse = _power_tables(seed, high - low + 1)
        running = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(codes[data[low:high]] * power[: high - low], out=running[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (running[e] - running[s]) * inverse[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


@dataclass
class Texts:
    """Texts of one slice as one byte buffer: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def slices(batch: pa.RecordBatch | pa.Array, column: str | None = None) -> Iterator:
    """Cuts a batch (or a string array) so that each part holds about SLICE_BYTES of text."""
    if not len(batch):
        return
    texts = batch.column(batch.schema.get_field_index(column)) if column else batch
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(length) - 1) // SLICE_BYTES
    cuts = np.flatnonzero(np.diff(part)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(batch)]):
        yield batch.slice(int(low), int(high - low))
    release()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@dataclass
class Words:
    """Words of a slice: byte spans, the text of each, and first[i]:first[i + 1] for text i."""

    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: Texts, separators: np.ndarray, data: np.ndarray | None = None) -> Words:
    """Maximal runs of non-separator bytes, never across two texts."""
    data = texts.data if data is None else data
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1 : n + 1] = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[texts.offsets] = True
    starts = np.flatnonzero(inside[1 : n + 1] & (~inside[:n] | edge[:n]))
    ends = np.flatnonzero(inside[1 : n + 1] & (~inside[2:] | edge[1:])) + 1
    first = np.searchsorted(starts, texts.offsets)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(starts, ends, owner, first)


def window_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k items from each position on; the last k - 1 positions have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    base = np.uint64(_BASES[1 - seed])
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= base
        acc += hashes[j : j + n]
    return mix(acc + np.uint64(k))


def text_windows(words: Words, hashes: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Word positions at which a window of k words of one text starts, and its hash."""
    h = window_hashes(hashes, k, seed)
    at = np.flatnonzero(words.owner[: len(h)] == words.owner[k - 1 :]) if len(h) else np.zeros(0, np.int64)
    return at, h[at]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return np.ascontiguousarray(x).view(np.int64)
