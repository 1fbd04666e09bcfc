"""Rows that every task reads in blocks from the shared folder, and a task's own rows taken together in shards."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, parquet as pq
from pyspark.sql import DataFrame

from ..session import shared_folder, shipped


class Blocks:
    """A table of the shared folder, as batches of so many rows; none is empty."""

    def __init__(self, root: str, rows: int) -> None:
        self.root, self.rows = root, rows

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.root)
        for x in sorted(store.get_file_info(fs.FileSelector(base)), key=lambda x: x.path):
            if x.base_name.endswith(".parquet"):
                for batch in pq.ParquetFile(store.open_input_file(x.path)).iter_batches(self.rows):
                    if batch.num_rows:
                        yield batch


def stored(df: DataFrame, name: str, rows: int) -> Blocks:
    """df written for all tasks, which read it in blocks of so many rows; they can import this package then."""
    shipped(df.sparkSession)
    root = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(root)
    return Blocks(root, rows)


def shards(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A task's batches put together, so many rows or a batch more at once."""
    own, n = [], 0
    for b in batches:
        if b.num_rows:
            own.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(own).combine_chunks()
            own, n = [], 0
    if own:
        yield pa.Table.from_batches(own).combine_chunks()


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix; there are no null vectors, a null component is no number."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows to length one; of length nought they stay so."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)
