"""Which rows are read, and which keys several of them share, without moving texts or keys.

A row's node is a number made of its file's number and its place in the file, so that any task that reads the
files can name it. The nodes that are wanted are sent to all tasks as bitmaps (a bit for each row of the table, up to
MOST_ROWS rows); of larger tables the wanted rows are found by a shuffle.

Keys (64 bits) that several nodes have are found by parts of the key space: tasks send their distinct keys in packed
blocks, a part sorts those of all tasks, and its range of a bitmap says where some key is shared. The bitmap
has BITS_A_KEY bits for each key, 2^MOST_BITS at most; what else falls on a bit that is set is only kept in vain.
Marks set two bits each in a bitmap of their own: many more keys are looked up in it than are marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.common import materialize, only_places

ROW_BITS, CHUNK_BITS = 40, 16
MOST_ROWS = 1 << 29
#: Keys of a part, and those that a task holds before it sends them; bits of the bitmap for each key, and its bits at most as a power of two; the least bits of the bitmap of marks.
PART_KEYS, HELD, BITS_A_KEY, MOST_BITS, MARK_BITS = 1 << 20, 1 << 21, 16, 28, 24
_PACKED = 4  # bytes of a key within its part: two keys of a full part that agree in them (one in a thousand) are kept in vain
_ZSTD = dict(codec="zstd", asbytes=True)


def file_numbers(docs: DataFrame) -> dict[str, int]:
    """A number for each file of a located table; as many as its reader has listed on the driver."""
    return {r[0]: k for k, r in enumerate(sorted(docs.select("__sw_file").distinct().collect()))}


def nodes_of(batch: pa.RecordBatch, numbers: dict[str, int]) -> np.ndarray:
    files = batch.column("__sw_file").dictionary_encode()
    known = np.array([numbers[f] for f in files.dictionary.to_pylist()], np.int64)
    return known[files.indices.to_numpy()] << ROW_BITS | batch.column("__sw_row").to_numpy()


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that only some of their texts are Python strings at once; workers keep the memory that they once had."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class Wanted:
    """The texts of some nodes of a located table. df: what is to be read; texts() gives nodes and texts of its batches."""

    def __init__(self, docs: DataFrame, numbers, wanted: DataFrame, rows: int, places: Callable[[], DataFrame], most_rows: int = MOST_ROWS):
        """numbers: a broadcast of file_numbers(). wanted: node, each once. rows: how many docs has. places: gives __sw_file, __sw_row and node of those wanted, for a shuffle."""
        self.numbers, self.bits = numbers, None
        if rows <= most_rows:
            self.df = docs.select("__sw_file", "__sw_row", "text")
            self.bits = docs.sparkSession.sparkContext.broadcast(_bitmaps(wanted))
        else:
            self.df = only_places(docs.select("__sw_file", "__sw_row", "text"), materialize(places(), "wanted")).select("node", "text")

    def __getstate__(self) -> dict:
        return {"numbers": self.numbers, "bits": self.bits}  # what tasks need

    def texts(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
        for b in sliced(batches):
            if self.bits is None:
                yield b.column("node").to_numpy(), b.column("text").to_pylist()
                continue
            chunks, bitmaps = self.bits.value
            node = nodes_of(b, self.numbers.value)
            at = np.searchsorted(chunks, node >> CHUNK_BITS)
            at = np.minimum(at, max(0, len(chunks) - 1))
            low = node & ((1 << CHUNK_BITS) - 1)
            keep = (chunks[at] == node >> CHUNK_BITS) & (bitmaps[at, low >> 3] >> (low & 7).astype(np.uint8) & 1).astype(bool) if len(chunks) else np.zeros(len(node), bool)
            yield node[keep], b.column("text").filter(pa.array(keep)).to_pylist()


def _bitmaps(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of chunks of nodes, sorted, and a bitmap of each."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            node = np.sort(b.column("node").to_numpy())
            chunk, low = node >> CHUNK_BITS, node & ((1 << CHUNK_BITS) - 1)
            for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(chunk)) + 1) if len(node) else ():
                bits = found.setdefault(int(chunk[part[0]]), np.zeros(1 << CHUNK_BITS, bool))
                bits[low[part]] = True
        for k, bits in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pa.compress(np.packbits(bits, bitorder="little"), **_ZSTD)], pa.binary())], ["chunk", "bits"])

    dealt = nodes.select("node", F.shiftright("node", CHUNK_BITS).alias("chunk")).repartition("chunk").select("node")
    got = sorted(dealt.mapInArrow(collect, "chunk long, bits binary").collect())  # a bit for each row of the table
    size = 1 << (CHUNK_BITS - 3)
    chunks = np.array([r.chunk for r in got], np.int64)
    return chunks, np.frombuffer(b"".join(pa.decompress(r.bits, size, **_ZSTD) for r in got), np.uint8).reshape(-1, size)


def flagged(keys: np.ndarray, asks: np.ndarray, several: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, without their two lowest bits; whether any of a key's rows asks, and whether it has several rows or one of them says so."""
    two = np.uint64(3)
    k = keys & ~two | asks.astype(np.uint64) << np.uint64(1)  # sorted with its flags: the last of equal keys asks if any does
    if several is not None:
        k |= several.astype(np.uint64)
    k.sort()
    base = k & ~two
    last = np.append(base[1:] != base[:-1], True) if len(k) else np.empty(0, bool)
    at = np.flatnonzero(last)
    flags = k[at] & two
    return base[at], flags >= np.uint64(2), (np.diff(at, prepend=-1) > 1) | (flags & np.uint64(1)).astype(bool)


def _sent(keys: np.ndarray, asks: np.ndarray, several: np.ndarray, part_bits: int) -> Iterator[tuple[int, int, bytes]]:
    """Sorted keys as (part, n, block): the part is named by the highest bits; the block has the steps between the bits that follow, by planes of bytes, and the flags."""
    part = (keys >> np.uint64(64 - part_bits)).astype(np.int64) if part_bits else np.zeros(len(keys), np.int64)
    rest = ((keys << np.uint64(part_bits)) >> np.uint64(64 - 8 * _PACKED)).astype("<u4")
    flags = asks | several.astype(np.uint8) << 1
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        steps = np.diff(rest[a:b], prepend=np.zeros(1, "<u4")).view(np.uint8).reshape(-1, _PACKED)
        yield int(part[a]), int(b - a), np.ascontiguousarray(steps.T).tobytes() + flags[a:b].tobytes()


def _received(n: int, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys within their part and their flags."""
    data = np.frombuffer(block, np.uint8).reshape(_PACKED + 1, n)
    return np.cumsum(np.ascontiguousarray(data[:_PACKED].T).reshape(-1).view("<u4"), dtype=np.uint32).astype(np.uint64), data[_PACKED]


_BLOCKS = "part int, n int, block binary"


def _batches(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "n", "block"])

    for row in rows:
        out.append(row)
        held += len(row[2])
        if held >= 1 << 22:
            yield batch()
            out, held = [], 0
    if out:
        yield batch()


class Shared:
    """Bitmaps of shared keys and of marks."""

    def __init__(self, bitmap: np.ndarray, bits: int, marks: np.ndarray):
        self.bitmap, self.bits, self.marks, self.any_marks = bitmap, bits, marks, bool(marks.any())

    def __getstate__(self) -> dict:
        """Compressed: the driver and each executor write what is broadcast to their disks."""
        return vars(self) | {k: (len(x), pa.compress(x, **_ZSTD)) for k, x in (("bitmap", self.bitmap), ("marks", self.marks))}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state | {k: np.frombuffer(pa.decompress(state[k][1], state[k][0], **_ZSTD), np.uint8) for k in ("bitmap", "marks")})

    def has(self, keys: np.ndarray) -> np.ndarray:
        return _has(self.bitmap, keys >> np.uint64(64 - self.bits))

    def marked(self, keys: np.ndarray) -> np.ndarray:
        first, second = _mark_places(keys, self.marks)
        found = _has(self.marks, first)
        some = np.flatnonzero(found)
        found[some] = _has(self.marks, second[some])
        return found


def _has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    at = at.astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _mark_places(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last = np.uint64(8 * len(marks) - 1)
    return keys & last, keys >> np.uint64(32) & last


def mark(keys: np.ndarray, marks: np.ndarray) -> None:
    for at in _mark_places(keys, marks):
        at = at.astype(np.int64)
        np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))


def shared_keys(source: Wanted, keys_of: Callable[[list[str]], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], keys: int, mark_bits: int = MARK_BITS) -> Shared:
    """The keys that several nodes of source have and one of them asks for.

    keys_of gives for each text its distinct keys, which of them it asks for, and marks, which are gathered in a bitmap of their own of 2^mark_bits bits. keys: about how many all have.
    """
    part_bits = max(0, (keys // PART_KEYS).bit_length())
    bits = max(12, min(MOST_BITS, (keys * BITS_A_KEY).bit_length()), part_bits + 3)
    bits = min(bits, part_bits + 8 * _PACKED)
    slices = 16

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, pending, n = np.zeros(1 << (mark_bits - 3), np.uint8), [], 0

        def flushed():
            nonlocal pending, n
            if pending:
                ks, asks = (np.concatenate(x) for x in zip(*pending, strict=True))
                pending, n = [], 0
                yield from _sent(*flagged(ks, asks), part_bits)

        def rows():
            nonlocal n
            for _, texts in source.texts(batches):
                for ks, asks, marked in keys_of(texts):
                    pending.append((ks, asks))
                    n += len(ks)
                    if len(marked):
                        mark(marked, marks)
                    if n >= HELD:
                        yield from flushed()
            yield from flushed()
            for k, piece in enumerate(marks.reshape(slices, -1)):
                if piece.any():
                    yield -1 - k, len(piece), pa.compress(piece, **_ZSTD)

        yield from _batches(rows())

    def judged(part: int, blocks: list[tuple[int, bytes]]) -> tuple[int, int, bytes]:
        if part < 0:
            pieces = [np.frombuffer(pa.decompress(x, n, **_ZSTD), np.uint8) for n, x in blocks]
            return part, blocks[0][0], pa.compress(np.bitwise_or.reduce(pieces), **_ZSTD)
        rest, flags = (np.concatenate(x) for x in zip(*(_received(n, x) for n, x in blocks), strict=True))
        found, asks, several = flagged(rest << np.uint64(2), (flags & 1).astype(bool), (flags & 2).astype(bool))
        found >>= np.uint64(2)
        keep = found[asks & several]
        own = bits - part_bits  # bits that name a place in the part's range of the bitmap
        here = np.zeros(1 << own, np.uint8)
        here[(keep >> np.uint64(8 * _PACKED - own)).astype(np.int64)] = 1
        return part, len(here) // 8, pa.compress(np.packbits(here, bitorder="little"), **_ZSTD)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, blocks = None, []
            for b in batches:
                for part, n, block in zip(*(b.column(c).to_pylist() for c in ("part", "n", "block")), strict=True):
                    if part != now and blocks:
                        yield judged(now, blocks)
                        blocks = []
                    now = part
                    blocks.append((n, block))
            if blocks:
                yield judged(now, blocks)

        yield from _batches(rows())

    sent = source.df.mapInArrow(collect, _BLOCKS)
    found = sent.repartition(min(4096, (1 << part_bits) + slices), "part").sortWithinPartitions("part").mapInArrow(judge, _BLOCKS).collect()  # both bitmaps, of bounded sizes
    shared, marks = np.zeros(1 << (bits - 3), np.uint8), np.zeros((slices, (1 << (mark_bits - 3)) // slices), np.uint8)
    each = 1 << (bits - 3 - part_bits)
    for r in found:
        piece = np.frombuffer(pa.decompress(r.block, r.n, **_ZSTD), np.uint8)
        if r.part < 0:
            marks[-1 - r.part] = piece
        else:
            shared[r.part * each:(r.part + 1) * each] = piece
    return Shared(shared, bits, marks.reshape(-1))
