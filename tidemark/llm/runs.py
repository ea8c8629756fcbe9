"""Streaming over sorted partitions: whole runs of rows with one key, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterable[pa.RecordBatch], *key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs and the bounds of the runs in them. Keys are integers without nulls."""
    held: list[pa.RecordBatch] = []

    def ends(t) -> np.ndarray:
        change = np.zeros(t.num_rows - 1, bool)
        for k in key:
            c = t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(k).to_numpy()
            change |= c[1:] != c[:-1]
        return np.flatnonzero(change) + 1

    for b in batches:
        if b.num_rows == 0:
            continue
        if held and all(held[-1].column(k)[-1] == b.column(k)[-1] for k in key):
            held.append(b)  # one long run goes on
            continue
        cuts = ends(b)
        last = int(cuts[-1]) if len(cuts) else 0
        t = pa.Table.from_batches([*held, b.slice(0, last)]) if held or last else None
        if t is not None and t.num_rows:
            yield t, np.concatenate(([0], ends(t), [t.num_rows]))
        held = [b.slice(last)]
    if held:
        t = pa.Table.from_batches(held)
        yield t, np.concatenate(([0], ends(t), [t.num_rows]))
