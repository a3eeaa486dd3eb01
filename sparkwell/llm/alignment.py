"""Operator 12: alignment of the tokens of two tokenizers by a sweep over their end offsets.

Each text is encoded by both tokenizers. The ends of their tokens are events; a row of the event table
holds a block of them (ids, whose byte lengths the vocabulary knows) of one side of one document with the
offset at which the block begins. The events of both sides are one table, dealt by document and sorted
by offset within partitions, and Sweep reads them in that order: wherever both sides have ended, a
group is closed, and between one end and the next lies one link, the pair of tokens that cover it. What it
holds is the tokens since the last common end, one block of each side, whatever the document's length.

Counts of linked id pairs are taken from each document's distinct pairs, summed in tasks before they move.
Up to BROADCAST_PAIRS pairs are sent to all tasks as sorted arrays (16 bytes each); more are joined by a shuffle.

Defined cases: null and empty texts, and texts that one of the tokenizers doesn't give back byte by byte,
have no tokens: zeros, and '' for the groups; a null doc_id is kept; repeated rows are aligned and counted
each; ties of counts are all best; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.llm.bpe import BYTE_BPE, encoder
from sparkwell.llm.common import materialize, table, text_of, vocabulary_path, workspace

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
#: Tokens of one event row.
BLOCK = 16384
#: Pairs that are sent to all tasks.
BROADCAST_PAIRS = 4_000_000
#: Links and pairs that are held before they are counted, and rows of a batch.
HELD, ROWS = 1 << 20, 512


class _Bytes:
    """Byte-level BPE of space and text."""

    def __init__(self, name: str):
        e = encoder(name)
        self._encode = e.encode
        vocabulary = e.tokenizer.get_vocab(with_added_tokens=True)
        back = {chr(v): b for b, v in _byte_characters().items()}
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self._encode(" " + text), "<u4")


def _byte_characters() -> dict[int, int]:
    from sparkwell.llm import bpe

    return bpe._BYTES


class _Pieces:
    """SentencePiece of a text, to which it adds a space."""

    def __init__(self, name: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.sp.encode(text), "<u4")


@lru_cache(maxsize=1)
def _sides(a: str, b: str) -> tuple[_Bytes, _Pieces]:
    return _Bytes(a), _Pieces(b)


@lru_cache(maxsize=1)
def _lengths(a: str, b: str) -> list[np.ndarray]:
    return [np.array([len(x) for x in s.raw], np.int64) for s in _sides(a, b)]


def _packed(ids: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(ids, asbytes=True)


def _unpacked(data: bytes, n: int, kind: str) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.Codec("zstd").decompress(data, size, asbytes=True) if n else b"", kind)


def _narrow(vocabulary: list[bytes]) -> str:
    return "<u2" if len(vocabulary) <= 1 << 16 else "<u4"


_EVENTS = "row long, doc_id long, at long, side int, n int, ids binary"


def events(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """Blocks of token ends of both sides; a document without tokens has one empty block."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, lengths = _sides(a, b), _lengths(a, b)
        kinds = [_narrow(s.raw) for s in sides]
        for batch in batches:
            out = []
            for row, doc_id, t in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = t.as_py()
                whole, blocks = b" " + text.encode(), []
                for side, s in enumerate(sides) if text else ():
                    ids = s.encode(text)
                    if b"".join(map(s.raw.__getitem__, ids.tolist())) != whole:
                        blocks = []
                        break
                    at = 0
                    for k in range(0, len(ids), BLOCK):
                        part = ids[k:k + BLOCK]
                        blocks.append((row, doc_id, at, side, len(part), _packed(part.astype(kinds[side]))))
                        at += int(lengths[side][part].sum()) if k + BLOCK < len(ids) else 0
                out += blocks or [(row, doc_id, 0, 0, 0, b"")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _EVENTS.split(", ")])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(encode, _EVENTS)


def dealt(found: DataFrame) -> DataFrame:
    """Events by document, in the order of their offsets."""
    return found.repartition("row").sortWithinPartitions("row", "at", "side")


class Step:
    """What a sweep has found since its last step: links (indices and ids of both sides) and closed groups (ids of each side with the group of each)."""

    def __init__(self, a, b, ia, ib, closed, groups):
        self.a, self.b, self.ia, self.ib, self.closed, self.groups = a, b, ia, ib, closed, groups


class Sweep:
    """The machine of one document: blocks of both sides in the order of their offsets."""

    def __init__(self, lengths: list[np.ndarray]):
        self.lengths, none = lengths, np.empty(0, np.int64)
        self.ids, self.ends = [none, none], [none, none]  # tokens since the last common end
        self.end, self.before, self.linked = [0, 0], [0, 0], 0

    def feed(self, side: int, ids: np.ndarray) -> Step | None:
        ids = ids.astype(np.int64)
        ends = np.cumsum(self.lengths[side][ids]) + self.end[side]
        self.ids[side] = np.concatenate((self.ids[side], ids)) if len(self.ids[side]) else ids
        self.ends[side] = np.concatenate((self.ends[side], ends)) if len(self.ends[side]) else ends
        self.end[side] = int(ends[-1])
        limit = min(self.end)
        if limit <= self.linked:
            return None
        (ea, eb), (ia, ib) = self.ends, self.ids
        u = np.concatenate([e[slice(*np.searchsorted(e, (self.linked, limit), "right"))] for e in (ea, eb)])
        u.sort(kind="stable")
        same = u[1:] == u[:-1]
        common = u[1:][same]
        u = u[np.append(True, ~same)]
        a, b = np.searchsorted(ea, u), np.searchsorted(eb, u)
        step = Step(a + self.before[0], b + self.before[1], ia[a], ib[b], None, len(common))
        if len(common):
            cut = [int(np.searchsorted(e, common[-1], "right")) for e in (ea, eb)]
            step.closed = [(i[:k], np.searchsorted(common, e[:k])) for i, e, k in zip(self.ids, self.ends, cut, strict=True)]
            for side, k in enumerate(cut):
                self.ids[side], self.ends[side] = self.ids[side][k:], self.ends[side][k:]
                self.before[side] += k
        self.linked = limit
        return step


def sweeps(batches: Iterable[pa.RecordBatch], a: str, b: str) -> Iterator[tuple[int, int | None, Iterator[Step]]]:
    """(row, doc_id, steps) of each document of a dealt partition; steps must be read before the next document is asked for."""
    lengths = _lengths(a, b)
    kinds = [_narrow(s.raw) for s in _sides(a, b)]

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "n", "ids")), strict=True)

    source = rows()
    ahead = next(source, None)
    while ahead:
        row, doc_id = ahead[:2]

        def steps():
            nonlocal ahead
            sweep = Sweep(lengths)
            while ahead and ahead[0] == row:
                _, _, side, n, data = ahead
                if n and (step := sweep.feed(side, _unpacked(data, n, kinds[side]))):
                    yield step
                ahead = next(source, None)

        now = steps()
        yield row, doc_id, now
        for _ in now:
            pass


def groups(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """row, doc_id, group (from 0), a_ids, b_ids: what lies between common ends."""

    def run(batches):
        for row, doc_id, steps in sweeps(batches, a, b):
            at = 0
            for s in steps:
                if s.closed:
                    ids = [np.split(i, np.flatnonzero(np.diff(g)) + 1) for i, g in s.closed]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row] * s.groups, pa.int64()), pa.array([doc_id] * s.groups, pa.int64()), pa.array(range(at, at + s.groups), pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in ids)],
                        ["row", "doc_id", "group", "a_ids", "b_ids"],
                    )
                    at += s.groups

    return dealt(events(docs, a, b)).mapInArrow(run, "row long, doc_id long, group long, a_ids array<long>, b_ids array<long>")


def links(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """row, doc_id, a, b (indices of the tokens), a_id, b_id: tokens whose byte ranges overlap."""

    def run(batches):
        for row, doc_id, steps in sweeps(batches, a, b):
            for s in steps:
                n = len(s.a)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), *(pa.array(x, pa.int64()) for x in (s.a, s.b, s.ia, s.ib))], ["row", "doc_id", "a", "b", "a_id", "b_id"])

    return dealt(events(docs, a, b)).mapInArrow(run, "row long, doc_id long, a long, b long, a_id long, b_id long")


@lru_cache(maxsize=1)
def _written(a: str, b: str) -> tuple[list[bytes], int, int]:
    """Ids in decimals behind their separators: a token within its side of a group, the first of a group, then the same for the other side."""
    n, m = (len(s.raw) for s in _sides(a, b))
    return [b"%s%d" % (mark, i) for marks, k in ((b",;", n), (b",|", m)) for mark in (marks[:1], marks[1:]) for i in range(k)], n, m


def group_text(step: Step, a: str, b: str) -> bytes:
    """The closed groups of a step as ;a1,a2|b1;a3|b2,b3."""
    words, n, m = _written(a, b)
    (ia, ga), (ib, gb) = step.closed
    first = [np.append(True, g[1:] != g[:-1]) for g in (ga, gb)]
    out = np.empty(len(ia) + len(ib), np.int64)
    out[np.arange(len(ia)) + np.searchsorted(gb, ga, "left")] = ia + n * first[0]
    out[np.arange(len(ib)) + np.searchsorted(ga, gb, "right")] = 2 * n + ib + m * first[1]
    return b"".join(map(words.__getitem__, out.tolist()))


def _counted(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their times."""
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(where, np.concatenate(times), len(found)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed: high bytes are mostly zero."""
    return _packed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def _from_planes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(_unpacked(data, 4 * n, "u1").reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


_ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_pairs int, pairs binary"


def _packed_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    return _planes(np.concatenate((np.diff(keys >> 32, prepend=0), keys & 0xFFFFFFFF, times)))


def _pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys (a << 32 | b) and times of the distinct linked pairs of each row."""
    for n, data in zip(batch.column("n_pairs").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
        a, b, times = _from_planes(data, 3 * n).reshape(3, -1) if n else np.empty((3, 0), np.int64)
        yield np.cumsum(a) << 32 | b, times


def aligned(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE) -> DataFrame:
    """One row per row of docs: numbers of tokens, groups and links, the digest of the groups and the distinct linked id pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.binary()]
        names = [x.split()[0] for x in _ALIGNED.split(", ")]
        out, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for row, doc_id, steps in sweeps(batches, a, b):
            digest, n_a, n_b, n_groups, n_links = hashlib.sha256(), 0, 0, 0, 0
            keys, times, waiting = [], [], 0
            for s in steps:
                if s.closed:
                    text = group_text(s, a, b)
                    digest.update(text if n_groups else text[1:])
                    n_groups += s.groups
                    n_a += len(s.closed[0][0])
                    n_b += len(s.closed[1][0])
                n_links += len(s.ia)
                keys.append(s.ia << 32 | s.ib)
                times.append(np.ones(len(s.ia), np.int64))
                waiting += len(s.ia)
                if waiting >= HELD:
                    k, t = _counted(keys, times)
                    keys, times, waiting = [k], [t], 0
            k, t = _counted(keys, times)
            out.append((row, doc_id, n_a, n_b, n_groups, n_links, digest.hexdigest() if n_groups else "", len(k), _packed_pairs(k, t)))
            held += len(k)
            if len(out) >= ROWS or held >= HELD:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return dealt(events(docs, a, b)).mapInArrow(run, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n (rows that hold it linked) and best (no pair of its a has more) of aligned rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times, waiting = [], [], 0
        for batch in batches:
            for k, _ in _pairs_of(batch):
                keys.append(k)
                times.append(np.ones(len(k), np.int64))
                waiting += len(k)
                if waiting >= 4 * HELD:
                    k, t = _counted(keys, times)
                    keys, times, waiting = [k], [t], len(k)
                    if len(k) >= 2 * HELD:  # few of them come again
                        yield from _pair_batches(k, t)
                        keys, times, waiting = [], [], 0
        yield from _pair_batches(*_counted(keys, times))

    counted = rows.select("n_pairs", "pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # the pairs of an id are at most as many as the other vocabulary has ids
    most = F.max("n").over(W.partitionBy(F.shiftright("pair", 32)))
    return counted.select("pair", "n", (F.col("n") == most).alias("best"))


def _pair_batches(keys: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[k:k + (1 << 16)]), pa.array(times[k:k + (1 << 16)])], ["pair", "n"])


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def alignment(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    spark = docs.sparkSession
    with workspace(spark, "align"):
        rows = materialize(aligned(docs, a, b), "align-rows")
        counts = materialize(pair_counts(rows), "align-pairs")
        if counts.count() <= broadcast_pairs:
            result = _summed(rows, counts)
        else:
            result = _joined(rows, counts)
        return materialize(result.select(*_RESULT), "aligned", outlives=True)


def _summed(rows: DataFrame, counts: DataFrame) -> DataFrame:
    got = counts.toArrow()
    pair = got.column("pair").to_numpy()
    order = np.argsort(pair)
    # the count, and in its lowest bit whether it is the best
    sent = rows.sparkSession.sparkContext.broadcast((pair[order], (got.column("n").to_numpy() * 2 + got.column("best").to_numpy())[order]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, value = sent.value
        for batch in batches:
            found = [(value[np.searchsorted(known, k)], t) for k, t in _pairs_of(batch)]
            best = pa.array([int(((v & 1) * t).sum()) for v, t in found], pa.int64())
            total = pa.array([int(((v >> 1) * t).sum()) for v, t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), best, total, batch.column("groups_sha256")], _RESULT)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _joined(rows: DataFrame, counts: DataFrame) -> DataFrame:
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (k, t) in zip(batch.column("row").to_pylist(), _pairs_of(batch), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), row)), pa.array(k), pa.array(t)], ["row", "pair", "times"])

    each = rows.select("row", "n_pairs", "pairs").mapInArrow(explode, "row long, pair long, times long")
    sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return rows.drop("pairs", "n_pairs").join(sums, "row", "left").withColumns({"n_best": F.coalesce("n_best", none), "count_sum": F.coalesce("count_sum", none)})


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents").select("doc_id", "text"))
