"""Operator 8: harmonic packing of documents into sequences of a fixed capacity.

A piece of l tokens belongs to the class k = capacity // l, and a bin of class k takes exactly k
pieces, whatever their documents. Workers fill the bins of their own partition without talking to
each other: no shuffle, one open bin for each class. Since documents may be cut, each is cut where
classes waste nothing: full sequences first, then the largest piece capacity // k that fits, until a
short rest is left, which goes to its own class whole. When a partition ends, the pieces of the bins
that are still open (fewer than one bin for each class) are laid one after the other and cut at the
capacity, and the last rest into powers of two, which need no padding.

Defined cases: null or empty text is the end token alone; a null doc_id is kept; repeated rows are
packed each; an empty table gives an empty result; other columns are ignored. Texts of any length
are tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sparkwell.llm.bpe import BYTE_BPE, encoder
from sparkwell.llm.common import table, text_of

CAPACITY = 2048
END_ID = 1
#: A rest of at most so many tokens isn't cut further: bins of its class waste less than its length.
WHOLE_REST = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_WIDTH = 4  # bytes of an id


def cuts(n: int, capacity: int = CAPACITY, whole_rest: int = WHOLE_REST) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest > whole_rest:
        out.append(capacity // -(-capacity // rest))
        rest -= out[-1]
    return out + [rest] * (rest > 0)


class Packer:
    """The bins of one worker. add() and close() yield rows of SCHEMA, as tuples."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity, self.sequence, self.open = capacity, first_sequence, {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // _WIDTH
            yield doc_id, start, n, zlib.crc32(ids), total, self.sequence, at
            at += n
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // _WIDTH, 0
        for n in cuts(total, self.capacity):
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append((doc_id, start, ids[start * _WIDTH:(start + n) * _WIDTH], total))
            start += n
            if len(bin_) == k:
                yield from self._close(self.open.pop(k))

    def close(self) -> Iterator[tuple]:
        """What is in open bins, cut anew: full sequences, then powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        todo = sum(len(p[2]) for p in left) // _WIDTH
        rows: list[tuple] = []
        room = 0
        for doc_id, start, ids, total in left:
            while ids:
                if not room:
                    room = self.capacity if todo >= self.capacity else 1 << (todo.bit_length() - 1)
                    todo -= room
                n = min(room, len(ids) // _WIDTH)
                rows.append((doc_id, start, ids[: n * _WIDTH], total))
                ids, start, room = ids[n * _WIDTH:], start + n, room - n
                if not room:
                    yield from self._close(rows)
                    rows = []


def _pack(batches: Iterable[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    encode, end = encoder(vocabulary).encode, END_ID.to_bytes(_WIDTH, "little")
    packer = Packer(TaskContext.get().partitionId() << 36, capacity)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    for b in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            rows.extend(packer.add(doc_id, encode(text.as_py()) + end))
        yield batch(rows)
    yield batch(list(packer.close()))


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, see SCHEMA: its document, place in it, checksum, sequence and place there."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(lambda it: _pack(it, vocabulary, capacity), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
