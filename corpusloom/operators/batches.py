"""Arrow batches cut to sizes that Python objects made of them can have."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows of a part, and bytes of a part of rows of like lengths.
ROWS, BYTES = 1024, 1 << 20


def parts(batches: Iterable[pa.RecordBatch], rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in their order, in parts of at most `rows` rows and about `size` bytes; no empty ones."""
    for b in batches:
        step = max(1, min(rows, size * b.num_rows // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)
