"""Vectorised work on UTF-8 bytes of many texts at once.

Texts come from Arrow columns without a Python object each; a chunk is a run of whole texts
whose bytes lie together in one numpy array. Hashes are polynomials modulo 2**64 over random
byte values, so that the hash of any substring is a difference of two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 4000
_rng = np.random.default_rng(20240229)
BYTE_VALUES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1) for _ in range(2)]
_BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_LENGTH = [U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)]
_powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint64), np.ones(1, np.uint64))] * 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    have = _powers[which]
    if len(have[0]) < n:
        size, base = 1 << max(16, (n - 1).bit_length()), _BASES[which]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            out = np.ones(1, np.uint64)
            while len(out) < size:
                out = np.concatenate((out, out * U(pow(b, len(out), 2**64))))
            both.append(out)
        _powers[which] = have = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Hashes of substrings of data."""

    def __init__(self, data: np.ndarray, which: int = 0) -> None:
        self.which = which
        pw, self.inverse = powers(len(data) + 1, which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * pw[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * _LENGTH[self.which])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each substring of this width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        raw = (self.sums[width:] - self.sums[:n]) * self.inverse[:n]
        return mix(raw + U(width * int(_LENGTH[self.which]) % 2**64))


@dataclass
class Chunk:
    """Texts lo..hi of a batch: bytes, and where each starts and ends in them."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    null: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that what is made of a batch stays small beside it."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (one more than texts) and null marks; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), null
    off = np.frombuffer(offsets, np.int64 if big else np.int32, len(column) + 1, column.offset * (8 if big else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off, null


def chunks(column: pa.Array, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Whole texts together, up to about `most` bytes; a longer text is a chunk of its own."""
    raw, off, null = text_buffers(column)
    lo, n = 0, len(null)
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, n)
        a, b = off[lo], off[hi]
        yield Chunk(lo, hi, raw[a:b], off[lo:hi] - a, off[lo + 1 : hi + 1] - a, null[lo:hi])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: hash, text that holds it, and bytes."""

    hash: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(chunk: Chunk) -> Words:
    """Runs of ASCII letters and digits and of bytes above 127, letters A-Z lower-cased."""
    data = chunk.data
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, z)
    word = IS_WORD[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = chunk.start[(chunk.start < n) & (chunk.end > chunk.start)]
    first[edge] = word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    close = chunk.end[chunk.end > chunk.start] - 1
    last[close] = word[close]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(chunk.end, s, "right")
    return Words(Prefix(LOWER[data]).of(s, e), doc, s, e)
