"""Arrow helpers for tasks that work on the flat values of list columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Values of a list column that a task works on at a time.
PIECE_VALUES = 1 << 20


def pieces(
    batches: Iterator[pa.RecordBatch], at: int, values: int = PIECE_VALUES
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches; lists of column ``at`` hold about ``values`` values in a slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes, dtype="int64") // values
        starts = np.flatnonzero(np.diff(parts, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(sizes)]):
            yield batch.slice(int(start), int(end - start))


def counted_values(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The distinct values of each list: its row, the value and how often it comes."""
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype("int64")
    coded = lists.flatten().dictionary_encode()
    width = max(1, len(coded.dictionary))
    keys = rows * width + coded.indices.to_numpy(zero_copy_only=False)
    keys, times = np.unique(keys, return_counts=True)
    return keys // width, coded.dictionary.take(pa.array(keys % width)), times
