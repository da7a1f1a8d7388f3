"""Arrow batches cut by the bytes of their texts, so that few texts at a time become Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 2_000_000
STORE: dict = {}


def worker_store(key: object, make: Callable):
    """What an operator remembers from task to task in a worker process.  There is one such store: asking for another, or for
    none (``no_store``), drops it, so that the stages of a pipeline do not add up in a worker that lives through them."""
    if key not in STORE:
        STORE.clear()
        STORE[key] = make()
    return STORE[key]


def no_store() -> None:
    STORE.clear()


def by_bytes(batches: Iterable[pa.RecordBatch], at: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose values in column ``at`` have about ``most`` bytes; a longer text is its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        begin = 0
        for end in ends:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end
