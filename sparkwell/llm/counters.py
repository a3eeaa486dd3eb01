"""How many rows have a hash, counted for all hashes of all rows in a table of a fixed size.

As in feature hashing, a hash counts in the counter that its low bits name. A counter so holds the
rows of its own hashes, and on average (mean hashes of a row) / COUNTERS of all rows from others.
Each task counts its rows and sends PARTS parts, in bytes of the least width that holds them; parts
are summed by as many keys, all of the same size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COUNTERS, PARTS = 1 << 20, 256

_SCHEMA = "part int, rows long, width int, counters binary"
_NAMES = ["part", "rows", "width", "counters"]


def counter_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _batch(parts: list[int], rows: int, widths: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([rows] * len(parts), pa.int64()), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], _NAMES)


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part, the sum of its rows, which stand together."""
    now, rows, total = None, 0, np.zeros(COUNTERS // PARTS, np.int64)
    for b in batches:
        for part, n, width, data in zip(b.column("part").to_pylist(), b.column("rows").to_pylist(), b.column("width").to_pylist(), b.column("counters"), strict=True):
            if now not in (None, part):
                yield _batch([now], rows, [8], [total.tobytes()])
                rows, total = 0, np.zeros_like(total)
            now, rows = part, rows + n
            total += np.frombuffer(data.as_buffer(), f"u{width}").astype(np.int64)
    if now is not None:
        yield _batch([now], rows, [8], [total.tobytes()])


def count_rows(texts: DataFrame, hashes: Callable[[Iterator[str]], Iterator[np.ndarray]]) -> tuple[int, np.ndarray]:
    """Rows of texts (text) and the counters of them all; hashes gives each text its distinct hashes."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, rows, pending, n = np.zeros(COUNTERS, np.int64), 0, [], 0
        for b in batches:
            for h in hashes(t.as_py() for t in b.column("text")):
                pending.append(counter_of(h))
                n += len(h)
                if n >= COUNTERS // 4:
                    counters += np.bincount(np.concatenate(pending), minlength=COUNTERS)
                    pending, n = [], 0
            rows += b.num_rows
        if not rows:
            return
        if n:
            counters += np.bincount(np.concatenate(pending), minlength=COUNTERS)
        parts = [p.astype(np.min_scalar_type(int(p.max()))) for p in counters.reshape(PARTS, -1)]
        yield _batch(list(range(PARTS)), rows, [p.itemsize for p in parts], [p.tobytes() for p in parts])

    each = texts.select("text").mapInArrow(counted, _SCHEMA)
    found = each.repartition("part").sortWithinPartitions("part").mapInArrow(_added, _SCHEMA).collect()  # PARTS rows, 8 bytes a counter
    counters = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for row in found:
        counters[row.part] = np.frombuffer(row.counters, np.int64)
    return (found[0].rows if found else 0), counters.reshape(-1)


class Tally:
    """Counters of what one task reads: add() takes the distinct hashes of a row, batches() gives what summed() adds up."""

    def __init__(self):
        self.counters, self.rows, self.pending, self.n = np.zeros(COUNTERS, np.int64), 0, [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.pending.append(counter_of(hashes))
        self.n += len(hashes)
        if self.n >= COUNTERS // 4:
            self._count()

    def _count(self) -> None:
        if self.n:
            self.counters += np.bincount(np.concatenate(self.pending), minlength=COUNTERS)
        self.pending, self.n = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self._count()
        if self.rows:
            parts = [p.astype(np.min_scalar_type(int(p.max()))) for p in self.counters.reshape(PARTS, -1)]
            yield _batch(list(range(PARTS)), self.rows, [p.itemsize for p in parts], [p.tobytes() for p in parts])


def summed(each: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and counters of all tasks."""
    found = each.repartition("part").sortWithinPartitions("part").mapInArrow(_added, _SCHEMA).collect()  # PARTS rows, 8 bytes a counter
    counters = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for row in found:
        counters[row.part] = np.frombuffer(row.counters, np.int64)
    return (found[0].rows if found else 0), counters.reshape(-1)
