"""Bounded steps through Arrow batches for the operators that run Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a step holds at once; a single longer document goes alone.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of a text column each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < len(sizes):
            yield batch.slice(start)


def mapper(step: Callable[[pa.RecordBatch], pa.RecordBatch], column: str):
    """A mapInArrow function that applies ``step`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, column):
            yield step(part)

    return run


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's values; null is the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
