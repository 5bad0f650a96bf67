"""What several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.components import connected_components
from ..shipping import ship
from ..storage import discard, materialize, shared_dir, small_broadcasts

__all__ = ["connected_components", "discard", "map_arrow", "map_texts", "materialize", "row_slices", "shared_dir", "small_broadcasts", "text_or_empty"]

#: Text bytes that a mapper turns into one output batch.
BATCH_BYTES = 4 << 20


def release() -> None:
    """Hand unused memory of a worker, which lives on, back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_slices(batch: pa.RecordBatch, text_at: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` so that the texts of a slice take ``limit`` bytes at most,
    but for single rows that are longer."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list], list]],
    schema: str,
    arrow: pa.Schema,
    id_col: str,
    text_col: str,
) -> DataFrame:
    """Run over (id, text) rows with Arrow batches of bounded size.

    ``make`` builds, once a task, a function from the lists of ids and texts
    (null as empty) to one list of values for each column of ``arrow``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in row_slices(batch, 1):
                columns = step(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
        getattr(step, "close", lambda: None)()

    narrow = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return map_arrow(narrow, run, schema)
