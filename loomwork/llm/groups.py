"""Rows of one key at a time from partitions that are sorted by it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys; memory holds one group and one batch."""
    held: list[pa.RecordBatch] = []

    def key(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = pa.array([False] * (batch.num_rows - 1), pa.bool_())
        for k in keys:
            column = batch.column(batch.schema.get_field_index(k))
            change = pc.or_(change, pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)), True))
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            piece = batch.slice(a, b - a)
            if held and key(held[0], 0) != key(piece, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)
