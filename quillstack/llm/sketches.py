"""Fixed-size sketches built by tasks, merged in a tree of bounded fan-in, and read by the driver.

A sketch is cut into segments; each task emits its own segments compressed, and groups of at most
FAN_IN tasks merge per segment until one of each is left. What reaches the driver is the size of
one sketch, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

FAN_IN = 64
SEGMENT = 1 << 18
SCHEMA = "part long, name string, segment int, payload binary"
_ARROW = pa.schema([("part", pa.int64()), ("name", pa.string()), ("segment", pa.int32()), ("payload", pa.binary())])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def emit(arrays: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The arrays of a task, in segments; empty segments are left out."""
    part = TaskContext.get().partitionId()
    for name, a in arrays.items():
        flat = a.reshape(-1)
        step = max(1, SEGMENT // flat.itemsize)
        for k in range(0, len(flat), step):
            piece = flat[k : k + step]
            if piece.any():
                yield pa.record_batch([[part], [name], [k // step], [squeeze(piece.tobytes())]], schema=_ARROW)


def gather(sketches: DataFrame, tasks: int, shapes: dict[str, tuple[np.dtype, tuple[int, ...]]], join: Callable[[list[bytes], str], bytes]) -> dict[str, np.ndarray]:
    """Merged sketches on the driver. join(payloads, name) merges segments of equal name and number."""

    def merged(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part, name, segment = key
        out = squeeze(join([expand(x) for x in group.payload], name))
        return pd.DataFrame({"part": [part], "name": [name], "segment": [segment], "payload": [out]})

    while True:
        tasks = -(-tasks // FAN_IN)
        sketches = sketches.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part", "name", "segment").applyInPandas(merged, SCHEMA)
        if tasks <= 1:
            break
    out = {name: np.zeros(int(np.prod(shape)), kind) for name, (kind, shape) in shapes.items()}
    for row in sketches.select("name", "segment", "payload").collect():
        flat = out[row.name]
        step = max(1, SEGMENT // flat.itemsize)
        piece = np.frombuffer(expand(bytes(row.payload)), flat.dtype)
        flat[row.segment * step : row.segment * step + len(piece)] = piece
    return {name: out[name].reshape(shape) for name, (_, shape) in shapes.items()}


def add_up(kind: str) -> Callable[[list[bytes], str], bytes]:
    def join(payloads: list[bytes], _: str) -> bytes:
        total = np.frombuffer(payloads[0], kind).copy()
        for x in payloads[1:]:
            total += np.frombuffer(x, kind)
        return total.tobytes()

    return join


class SeenTwice:
    """Two Bloom filters over 64-bit hashes: seen once, and seen twice or more.

    The second holds every hash that was added twice, in one task or in two; some others too.
    Bits set in the first filters of two tasks carry over into the second when they merge.
    """

    PROBES = 2

    def __init__(self, bits: int) -> None:
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8)
        self.twice = np.zeros(bits // 8, np.uint8)

    def _places(self, hashes: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask).astype(np.int64)]

    @staticmethod
    def _hit(table: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        out = None
        for p in places:
            bit = (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1
            out = bit if out is None else out & bit
        return out.astype(bool)

    @staticmethod
    def _set(table: np.ndarray, places: list[np.ndarray]) -> None:
        for p in places:
            p = np.sort(p)
            byte, value = p >> 3, np.left_shift(1, p & 7).astype(np.uint8)
            if len(byte):
                at = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
                table[byte[at]] |= np.bitwise_or.reduceat(value, at)

    def add(self, hashes: np.ndarray) -> None:
        if not len(hashes):
            return
        own, n = np.unique(hashes, return_counts=True)
        again = (n > 1) | self._hit(self.once, self._places(own))
        self._set(self.twice, self._places(own[again]))
        self._set(self.once, self._places(own))

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        both = np.empty((len(self.once) // 1024, 2, 1024), np.uint8)
        both[:, 0], both[:, 1] = self.once.reshape(-1, 1024), self.twice.reshape(-1, 1024)
        return {name: both}

    @staticmethod
    def join(payloads: list[bytes], _: str) -> bytes:
        total = np.frombuffer(payloads[0], np.uint8).reshape(-1, 2, 1024).copy()
        for x in payloads[1:]:
            more = np.frombuffer(x, np.uint8).reshape(-1, 2, 1024)
            total[:, 1] |= more[:, 1] | (total[:, 0] & more[:, 0])
            total[:, 0] |= more[:, 0]
        return total.tobytes()

    def shape(self) -> tuple[np.dtype, tuple[int, ...]]:
        return np.dtype(np.uint8), (self.bits // 8192, 2, 1024)

    @classmethod
    def reader(cls, twice: np.ndarray) -> SeenTwice:
        """The second filter alone, as tasks are given it."""
        out = cls(8192)
        out.bits, out.twice = 8 * twice.size, twice
        return out

    def suspected(self, hashes: np.ndarray) -> np.ndarray:
        return self._hit(self.twice, self._places(hashes))


def filter_bits_for(docs: DataFrame, bytes_a_key: int, least: int = 1 << 22, most: int = 1 << 28) -> int:
    """Bits of a filter for the keys that texts of docs may hold: eight a key, by the size of its files.

    Beyond `most` bits filters stay as they are, more keys are suspected and moved, and results stay exact.
    """
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # a plan without files does not know its size
        return 1 << 24
    # files are compressed to a third or so
    return min(most, max(least, 1 << (8 * (3 * size // bytes_a_key)).bit_length()))


def seen_twice(source: DataFrame, hashes_of: Callable[[pa.RecordBatch], dict[str, np.ndarray]], bits: dict[str, int]) -> dict[str, SeenTwice]:
    """Filters of each name over all rows of source; hashes_of gives the hashes of a batch by name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: SeenTwice(n) for name, n in bits.items()}
        for batch in batches:
            for part in hashes_of(batch):
                for name, hashes in part.items():
                    own[name].add(hashes)
        for name, x in own.items():
            yield from emit(x.arrays(name))

    tasks = source.rdd.getNumPartitions()
    found = gather(source.mapInArrow(task, SCHEMA), tasks, {name: SeenTwice(n).shape() for name, n in bits.items()}, SeenTwice.join)
    out = {}
    for name, n in bits.items():
        x = SeenTwice(n)
        x.once, x.twice = np.zeros(0, np.uint8), np.ascontiguousarray(found[name][:, 1]).reshape(-1)
        out[name] = x
    return out
