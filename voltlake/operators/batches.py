"""Arrow batches of rows whose samples are lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Samples that a worker handles at once, unless one row alone has more: what kernels make of them is several times as much.
SLICE = 1 << 15


def sliced(batches: Iterable[pa.RecordBatch], column: str = "samples", limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` (SLICE) samples, or one row."""
    limit = limit or SLICE
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
            # Rows without samples count, too.
            to = min(to, at + limit)
            yield batch.slice(at, to - at)
            at = to


def arrays(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list column as views of its values."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    return [values[a:b] for a, b in zip(np.concatenate(([0], ends[:-1])), ends, strict=True)]


def lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0)]).astype(np.float64)))
