"""Reading sorted Arrow batches as runs of equal keys inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end between runs, with the run starts (and the end) as row numbers.

    The input is sorted so that rows with equal keys are neighbours. A table holds whole runs and at
    least `rows` rows (the last one may hold fewer), so memory follows the longest run.
    """
    held: list[pa.RecordBatch] = []
    n = 0

    def table() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held)
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return t, np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t, starts = table()
        cut = starts[-2]
        if cut:
            yield t.slice(0, cut), starts[:-1]
            rest = t.slice(cut).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield table()
