"""Arrow batches cut by bytes, so that what a map makes of one stays small whatever its rows hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of one column in a piece; a larger value stands alone.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, cut before the row that takes a column over ``most`` bytes."""
    for batch in batches:
        start, held = 0, 0
        for i, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size = size or 0
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
