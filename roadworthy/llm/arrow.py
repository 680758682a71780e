"""Texts of Arrow batches as bytes, for the operators that work in Python tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all values' bytes end to end, offsets) of a string or binary column; null is empty."""
    values = column.cast(pa.binary())
    if values.null_count:
        values = values.fill_null(b"")
    _, offsets, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    ends = np.frombuffer(offsets, np.int32)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds at most ``most`` bytes of column ``name``, or a single row."""
    for batch in batches:
        total, start = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(name)).fill_null(0).to_pylist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def mapped(columns: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: pa.Schema, text: str = "text", most: int = 8 << 20):
    """A function for ``mapInArrow`` that turns each bounded piece into the given columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, most):
            made = columns(piece)
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)

    return run
