"""Reading sorted rows group by group from Arrow batches, with one group in memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def by_bucket(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...] = (1,)) -> Iterator[tuple[object, list]]:
    """(first column's value, its rows) for rows that are sorted by their first column.

    A row is the value of the one column asked for, or a tuple of several.
    """
    now, held, begun = None, [], False
    for batch in batches:
        for i in range(0, batch.num_rows, 64):  # payloads are large: few at a time become Python objects
            part = batch.slice(i, 64)
            cells = [part.column(c).to_pylist() for c in columns]
            for k, *row in zip(part.column(0).to_pylist(), *cells, strict=True):
                if begun and k != now:
                    yield now, held
                    held = []
                now, begun = k, True
                held.append(row[0] if len(columns) == 1 else tuple(row))
    if begun:
        yield now, held
