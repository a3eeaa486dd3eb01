"""Operator 13: exact Jaccard join of texts on word n-grams, by a pigeonhole over partitions of the universe.

A text is the set of hashes of its shingles. Sets are banded by size so that a set's partners of at
most its size lie in its own band or the one below. For each band the universe of hashes is dealt into
as many segments as two partners can differ in, and one more: so the two agree on a whole segment. A set
is indexed by the content of each of its segments, in the partition of its own band and, as the smaller of a pair, of
the next. The larger one of a pair asks. It may leave out segments and make up for each by asking for
another one up to one item: by its content without any one item, and in the neighbourhoods that other sets get by leaving
one item out. It leaves out what its band's slack allows and those segments that hold many more sets than its others,
where the neighbourhood of a small segment costs less. How many sets of its band a segment holds is counted over all rows (counters.py).

Keys that only one set has, or that none asks for, are left behind before any row moves, and texts don't move at all
(sharing.py). Neighbourhoods are indexed only where some set asks for them, found by a bitmap of a bounded size. What meets
is verified on the exact sets (linking.py).

Defined cases: null counts as empty; texts with fewer words than a shingle are one shingle of all of them; texts
without words have an empty set and are linked with nothing; equal sets are linked; null and repeated doc_ids are
rows of their own; a component is named by its smallest doc_id (null last); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import located, materialize, short_shuffles, table, text_of, workspace
from sparkwell.llm.counters import Tally, counter_of, summed
from sparkwell.llm.hashing import blank_word_blocks, mixed
from sparkwell.llm.linking import Sets, links
from sparkwell.llm.near_dedup import named
from sparkwell.llm.sharing import MARK_BITS, Wanted, file_numbers, nodes_of, shared_keys

SHINGLE = 4
#: Least similarity in hundredths.
PERCENT = 85
#: A segment is left out for a neighbourhood if it holds so many times what the set's other segments hold.
STANDS_OUT = 4
#: Bits of the bitmap of neighbourhoods that are asked for at most, as a power of two.
MOST_MARK_BITS = 27
#: Sets of so many items have wide sketches: the parities of smaller ones tell unlike sets apart.
WIDE_FROM = 2048

_F = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_WHOLE, _AROUND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def blocks_of(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the distinct shingles of texts, sorted for each text, block by block, and how many each text has."""
    for words, counts in blank_word_blocks(texts):
        ends = np.cumsum(counts)
        begins = ends - counts
        h = np.append(words, np.zeros(SHINGLE - 1, np.uint64))
        h = mixed(sum((h[j:j + len(words)] * _F[j] for j in range(1, SHINGLE)), h[:len(words)] * _F[0]) + np.uint64(SHINGLE))
        for k in range(1, SHINGLE):  # texts of k words
            at = begins[counts == k]
            if len(at):
                h[at] = mixed(sum((words[at + j] * _F[j] for j in range(k)), np.uint64(k)))
        begun = np.ones(len(h), bool)
        for j in range(1, SHINGLE):
            begun[ends[counts > j] - j] = False
        h = h[begun]
        n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
        ends = np.cumsum(n)
        for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
            h[a:b].sort()
        new = np.append(True, h[1:] != h[:-1])[:len(h)]
        new[(ends - n)[n > 0]] = True
        upto = np.append(0, np.cumsum(new))
        yield h[new], upto[ends] - upto[ends - n]


def sets_of(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The set of each text."""
    for items, sizes in blocks_of(texts):
        ends = np.cumsum(sizes)
        for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            yield items[a:b]


@lru_cache(maxsize=4)
def bounds(percent: int) -> np.ndarray:
    """The least size of each band: the first one that is no partner of the band before's least."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def most_apart(size, percent: int):
    """In how many items a set of this size and a partner of at most its size differ at most."""
    return 2 * size * (100 - percent) // (100 + percent)


def bands_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(bounds(percent), sizes, "right") - 1


def segments(bands: np.ndarray, percent: int) -> np.ndarray:
    return most_apart(bounds(percent)[bands + 1] - 1, percent) + 1


class Cut:
    """Sets, one after the other, cut into the segments of a band for each: size, content and key of all segments in turn, and the set of each."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray, bands: np.ndarray, percent: int):
        m = segments(bands, percent)
        salt = mixed((bands + 1).astype(np.uint64) * _F[1])
        self.items, self.first, self.set = items, np.cumsum(m) - m, np.repeat(np.arange(len(m)), m)
        at = items * np.repeat(salt | np.uint64(1), sizes) >> np.uint64(32)
        at = (at * np.repeat(m.astype(np.uint64), sizes) >> np.uint64(32)).astype(np.int64)
        self.at = at + np.repeat(self.first, sizes)
        self.size = np.bincount(self.at, minlength=len(self.set))
        self.content = np.zeros(len(self.set), np.uint64)
        np.add.at(self.content, self.at, items)
        self.salt = (np.arange(1, len(self.set) + 1) - np.repeat(self.first, m)).astype(np.uint64) * _F[3] + np.repeat(salt, m)
        self.keys = self.key(self.content, slice(None))

    def key(self, content: np.ndarray, segment, kind: np.uint64 = _WHOLE) -> np.ndarray:
        return mixed(mixed(content + self.salt[segment]) ^ kind)

    def without_one(self, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The segment and its content without the item, for each item of the chosen segments."""
        those = np.zeros(len(self.set), bool)
        those[chosen] = True
        those = np.flatnonzero(those[self.at])
        return self.at[those], self.content[self.at[those]] - self.items[those]

    def around(self) -> np.ndarray:
        """The neighbourhood keys of all segments, item by item: of each without each of its items."""
        return mixed(mixed((self.content + self.salt)[self.at] - self.items) ^ _AROUND)


def asked(cut: Cut, sizes: np.ndarray, percent: int, held: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Which segments sets ask for as a whole, and those that they ask for up to one item.

    held: about how many sets each segment holds. Whatever it is, the segments that a set asks for count for more, the
    latter twice, than the set and a smaller partner can differ in.
    """
    m = np.diff(cut.first, append=len(cut.set))
    slack = m - (most_apart(sizes, percent) + 1)
    costly = np.argsort(cut.set * (held.max(initial=0) + 1.0) - held, kind="stable")  # of each set in turn
    whole = np.ones(len(cut.set), bool)
    whole[costly[np.arange(len(costly)) - cut.first[cut.set] < slack[cut.set]]] = False
    usual = (held[costly[cut.first + m // 2]] + held[costly[cut.first + (m - 1) // 2]]) / 2
    more: list[int] = []
    for k in np.flatnonzero(held[costly[cut.first + slack]] > STANDS_OUT * usual + 8).tolist():
        left = costly[cut.first[k] + slack[k]:cut.first[k] + m[k]]
        filled = left[cut.size[left] > 0]
        cheap = filled[np.lexsort((-filled, -(cut.size[filled] + STANDS_OUT * held[filled])))].tolist()
        chosen: set[int] = set()
        for segment in left.tolist():
            if held[segment] <= STANDS_OUT * usual[k] + 8:
                break
            while cheap and (not whole[cheap[-1]] or cheap[-1] == segment):
                cheap.pop()
            if not cheap or held[segment] <= held[cheap[-1]] + cut.size[cheap[-1]] + 1 or segment in chosen:
                break
            whole[segment] = False
            chosen.add(cheap.pop())
        more += chosen
    return whole, more


class Keys:
    """What sets are indexed by and ask for: keys, which of them are asked for, and the set of each; neighbourhoods asked for, and the set of each.

    items: the sets, none empty, one after the other; sizes: of each (None: one set).
    """

    def __init__(self, items: np.ndarray, percent: int, held, sizes: np.ndarray | None = None):
        self.sizes = np.array([len(items)]) if sizes is None else sizes
        bands = bands_of(self.sizes, percent)
        self.cuts = [Cut(items, self.sizes, bands, percent), Cut(items, self.sizes, bands + 1, percent)]
        own, below = self.cuts
        whole, more = asked(own, self.sizes, percent, held(own.keys))
        at, contents = own.without_one(more)
        self.keys = np.concatenate([own.keys, below.keys, own.key(contents, at)])
        self.asks = np.concatenate([whole, np.zeros(len(below.keys), bool), np.ones(len(at), bool)])
        self.set = np.concatenate([own.set, below.set, own.set[at]])
        self.around, self.around_set = own.key(own.content[more], more, _AROUND), own.set[more]

    def index_around(self) -> np.ndarray:
        """The neighbourhood keys of all items, once for each band."""
        return np.concatenate([c.around() for c in self.cuts])

    def around_of(self, marked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct neighbourhood keys of each set that are asked for or marked, whether it asks for them, and the set."""
        index = self.index_around()
        found = np.flatnonzero(marked(index))
        k = np.concatenate([self.around, index[found]])
        of = np.concatenate([self.around_set, np.tile(np.repeat(np.arange(len(self.sizes)), self.sizes), 2)[found]])
        order = np.lexsort((np.arange(len(k)) >= len(self.around), k, of))  # of equal keys one that asks comes first
        k, of = k[order], of[order]
        new = np.append(True, (k[1:] != k[:-1]) | (of[1:] != of[:-1]))[:len(k)]
        return k[new], (order < len(self.around))[new], of[new]


class Held:
    """About how many sets hold a key: its counter without what a counter usually holds of others."""

    def __init__(self, counters: np.ndarray):
        usual = float(np.median(counters))
        self.most = np.maximum(counters - usual - 4 * np.sqrt(usual) - 1, 0).astype(np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        return self.most[counter_of(keys)]


def _keys(texts: list[str], percent: int, held) -> Iterator[tuple[Keys, np.ndarray]]:
    """Keys of texts, block by block, and which of the texts the sets are."""
    at = 0
    for items, sizes in blocks_of(texts):
        of = np.flatnonzero(sizes)
        if len(of):
            yield Keys(items, percent, held, sizes[of]), of + at
        at += len(sizes)


def candidates(source: Wanted, keys: int, percent: int, held) -> DataFrame:
    """bucket and node of the sets of source that meet in a key which one of them asks for. keys: about how many all have."""
    found = shared_keys(source, lambda texts: ((k.keys, k.asks, k.around) for k, _ in _keys(texts, percent, held.value)), keys, max(MARK_BITS, min(MOST_MARK_BITS, keys.bit_length())))
    sent = source.df.sparkSession.sparkContext.broadcast(found)

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = sent.value
        for batch_nodes, texts in source.texts(batches):
            nodes, buckets, asking = [], [], []
            for k, of in _keys(texts, percent, held.value):
                keep = shared.has(k.keys)
                parts = [(k.keys[keep], k.asks[keep], k.set[keep])]  # distinct in a set, by their salts
                if shared.any_marks:
                    parts.append(k.around_of(shared.marked))
                for own, asks, owners in parts:
                    nodes.append(batch_nodes[of[owners]])
                    buckets.append(own.view(np.int64))
                    asking.append(asks)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (buckets, nodes, asking)], ["bucket", "node", "asks"])

    each = materialize(source.df.mapInArrow(members, "bucket long, node long, asks boolean"), "gram-keys")
    sent.destroy()
    useful = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked").select("bucket")
    return materialize(each.select("bucket", "node").join(useful, "bucket", "left_semi"), "gram-members")


_ROWS = "doc_id long, __sw_file string, __sw_row long, row long, d1 long, d2 long, n_shingles long"
_COUNTED = "part int, rows long, width int, counters binary"


def _signed(docs: DataFrame, numbers, percent: int) -> DataFrame:
    """Rows of _ROWS (row names the row, d1 and d2 are the digest of its set), and among them those of _COUNTED: counters of the keys of all rows in their own bands."""
    names = [x.split()[0] for x in f"{_ROWS}, {_COUNTED}".split(", ")]
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in batches:
            d1, d2, n = [], [], []
            for items, sizes in blocks_of(b.column("text").to_pylist()):
                ends = np.cumsum(sizes)
                for start, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    d = xxhash.xxh3_128_intdigest(items[start:end].tobytes())
                    d1.append((d >> 64) - (1 << 63))
                    d2.append((d & (1 << 64) - 1) - (1 << 63))
                n += sizes.tolist()
                sizes = sizes[sizes > 0]
                tally.add(Cut(items, sizes, bands_of(sizes, percent), percent).keys)
            tally.rows += len(n)
            own = [*(b.column(c) for c in ("doc_id", "__sw_file", "__sw_row")), pa.array(nodes_of(b, numbers.value), pa.int64()), *(pa.array(x, pa.int64()) for x in (d1, d2, n))]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(len(n), t) for t in types[len(own):]], names)
        for part in tally.batches():
            nulls = [pa.nulls(part.num_rows, t) for t in types[: len(types) - part.num_columns]]
            yield pa.RecordBatch.from_arrays(nulls + part.columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__sw_file", "__sw_row", "text")
    return rows.mapInArrow(sign, f"{_ROWS}, {_COUNTED}")


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, component_size, kept (the row that names its component), texts, __sw_file, __sw_row."""
    spark = docs.sparkSession
    docs = located(docs).select("doc_id", text_of().alias("text"), "__sw_file", "__sw_row")
    with workspace(spark, "gram"), short_shuffles(spark):
        numbers = spark.sparkContext.broadcast(file_numbers(docs))
        signed = materialize(_signed(docs, numbers, percent), "gram-rows")
        rows = signed.where("part is null").select(*(x.split()[0] for x in _ROWS.split(", ")))
        n_rows, counted = summed(signed.where("part is not null").select(*(x.split()[0] for x in _COUNTED.split(", "))))
        held = spark.sparkContext.broadcast(Held(counted))
        full = rows.where("n_shingles > 0")
        nodes = materialize(full.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.first("n_shingles").alias("n")), "gram-nodes")
        keys = nodes.agg(F.sum(F.col("n") * (4.4 * (100 - percent) / (100 + percent)) + 2)).first()[0]

        def wanted(chosen: DataFrame) -> Wanted:
            return Wanted(docs, numbers, chosen, n_rows, lambda: rows.join(chosen, F.col("row") == F.col("node"), "left_semi").select("__sw_file", "__sw_row", F.col("row").alias("node")))

        members = candidates(wanted(nodes.select("node")), int(keys or 0), percent, held)
        mean = full.agg(F.avg("n_shingles")).first()[0] or 1.0
        labels = links(members, Sets(wanted, sets_of, WIDE_FROM), percent / 100, mean)
        found = named(full, nodes.drop("n"), labels, ["d1", "d2"])
        alone = rows.where("n_shingles = 0").select("doc_id", "__sw_file", "__sw_row", "n_shingles", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), F.lit(1).cast("long").alias("texts"))
        return materialize(found.unionByName(alone).withColumnsRenamed({"class_id": "component_id", "class_size": "component_size"}), "gram-joined", outlives=True)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("__sw_file", "__sw_row")
