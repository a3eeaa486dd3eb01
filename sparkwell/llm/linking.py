"""Links within buckets whose members meet in many of them: sets of hashes, joined exactly.

What may link is bounded before sets are compared: by their sizes, by the items that no other candidate has, and by a sketch of
SKETCH parities. Each item flips one of them, so two sets differ in at least as many items as their sketches in bits. Sets of so many items
that these parities are as good as drawn can have a sketch of WIDE parities too, for the pairs that are left.

Every bucket is led by its most central member (that of the fullest buckets), so that the buckets of one family mostly have
one leader; each member is compared with one leader first, with which it shares most buckets. Buckets whose
members are then all in one class are done; in the others, those with the least of their own lead in rounds, for the pairs in
different classes that no bound rules out. So each linked pair of a bucket ends up in one class, and a group of copies costs
about one comparison for each member.

Sets are made from the texts when they are compared; they are never stored, and one of each pair is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.llm.common import BROADCAST_KEYS, materialize, merged, only_nodes
from sparkwell.llm.sharing import Wanted, shared_keys

#: Parities of a sketch, and of a wide one.
SKETCH, WIDE = 1 << 10, 1 << 14
#: Bytes of an item when sets are compared: two of 1,000 items share one by chance with probability 2e-9.
ITEM = 6


def jaccard_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - Jaccard similarity of two sorted sets that aren't both empty."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum()) if len(few) else 0
    return 1 - both / (len(a) + len(b) - both)


def packed_set(items: np.ndarray) -> bytes:
    """A sorted set of 64-bit hashes by their high ITEM bytes, as steps between them in planes of bytes."""
    high = items >> np.uint64(64 - 8 * ITEM)
    return np.ascontiguousarray(np.diff(high, prepend=np.zeros(1, np.uint64)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :ITEM].T).tobytes()


def unpacked_set(data) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(ITEM, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :ITEM] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=np.uint64)


def sketch_of(items: np.ndarray, width: int) -> np.ndarray:
    """Parities of a set by the highest bits of its hashes, in bytes."""
    return np.packbits((np.bincount((items >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width) & 1).astype(bool))


def most_apart(threshold: float, total):
    """In how many items two linked sets differ at most that have total items, common ones counted twice."""
    return (1 - threshold) / (1 + threshold) * total + 1e-9


class Sets:
    """The sets of the nodes of a table. wanted gives the texts of nodes (node, each once), sets_of the sorted sets of texts. wide: how many items a set with a wide sketch has at least."""

    def __init__(self, wanted: Callable[[DataFrame], Wanted], sets_of: Callable[[Iterable[str]], Iterator[np.ndarray]], wide: int | None = None):
        self.wanted, self.sets_of, self.wide = wanted, sets_of, wide

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and items."""
        source, sets_of = self.wanted(nodes), self.sets_of

        def collected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found, texts in source.texts(batches):
                for k in range(0, len(texts), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(found[k:k + 512]), pa.array(list(map(packed_set, sets_of(texts[k:k + 512]))), pa.binary())], ["node", "items"])

        return source.df.mapInArrow(collected, "node long, items binary")

    def possible(self, pairs: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
        """The pairs (a, b) without those that their wide sketches keep apart."""

        def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for total, x, y in zip(*(b.column(c).to_pylist() for c in ("total", "wa", "wb")), strict=True):
                    keep.append(x is None or y is None or int(np.bitwise_count(np.frombuffer(x, np.uint64) ^ np.frombuffer(y, np.uint64)).sum()) <= most_apart(threshold, total))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        wide = only_nodes(bounds.where("wide is not null").select("node", "all", "wide"), pairs)
        if wide.isEmpty():
            return pairs
        of = lambda c: wide.select(F.col("node").alias(c), F.col("all").alias(f"all_{c}"), F.col("wide").alias(f"w{c}"))
        full = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", (F.col("all_a") + F.col("all_b")).alias("total"), "wa", "wb")
        return materialize(full.mapInArrow(judge, "a long, b long"), "link-possible")

    def compared(self, pairs: DataFrame, bounds: DataFrame, threshold: float) -> DataFrame:
        """a, b and the Jaccard distance of those pairs (a, b) that may have a similarity of threshold or more; bounds: of bounds()."""

        def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, theirs = None, None
            for batch in batches:
                d = []
                for k, node in enumerate(batch.column("b").to_pylist()):
                    if node != last:  # pairs mostly come in the order of b
                        last, theirs = node, unpacked_set(batch.column("sb")[k].as_buffer())
                    d.append(jaccard_distance(unpacked_set(batch.column("sa")[k].as_buffer()), theirs))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d, pa.float64())], ["a", "b", "distance"])

        pairs = materialize(pairs, "link-pairs")
        if self.wide is not None:
            pairs = self.possible(pairs, bounds, threshold)
        few = pairs.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
        sets = lambda c: self.of(pairs.select(F.col(c).alias("node")).distinct()).withColumnsRenamed({"node": c, "items": f"s{c}"})
        full = sets("a").join(F.broadcast(pairs) if few else pairs, "a").join(sets("b"), "b")
        return materialize(full.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, distance double"), "link-compared")

    def bounds(self, nodes: DataFrame, items: int) -> DataFrame:
        """node, all and own: the size of a node's set, and how many of its items (or some fewer) no other of these nodes has; s0, s1, ...: its sketch; wide: its wide one, if any. items: about how many they have."""
        source, sets_of = self.wanted(nodes), self.sets_of
        none = np.empty(0, np.uint64)
        sent = nodes.sparkSession.sparkContext.broadcast(shared_keys(source, lambda texts: ((s, np.ones(len(s), bool), none) for s in sets_of(texts)), items))
        wide_from = self.wide

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found, texts in source.texts(batches):
                n, sketches, wide = [], [], []
                for s in sets_of(texts):
                    n.append((len(s), len(s) - int(sent.value.has(s).sum())))
                    sketches.append(sketch_of(s, SKETCH).view("<i8"))
                    wide.append(sketch_of(s, WIDE).tobytes() if wide_from is not None and len(s) >= wide_from else None)
                sketch = np.array(sketches, np.int64).reshape(-1, SKETCH // 64)
                yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array([x[k] for x in n], pa.int64()) for k in (0, 1)), *map(pa.array, np.ascontiguousarray(sketch.T)), pa.array(wide, pa.binary())], ["node", "all", "own", *_SKETCH, "wide"])

        found = materialize(source.df.mapInArrow(count, "node long, all long, own long, " + "".join(f"{c} long, " for c in _SKETCH) + "wide binary"), "link-bounds")
        sent.destroy()
        return found


_SKETCH = [f"s{k}" for k in range(SKETCH // 64)]


def may_link(threshold: float, a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether no bound keeps two nodes apart; a and b give the columns of Sets.bounds() of each."""
    shared_a, shared_b = a("all") - a("own"), b("all") - b("own")
    sizes = F.least(a("all"), b("all")) >= threshold * F.greatest(a("all"), b("all")) - 1e-9
    common = F.least(shared_a, shared_b) >= threshold * (a("own") + b("own") + F.greatest(shared_a, shared_b)) - 1e-9
    apart = reduce(lambda x, y: x + y, (F.bit_count(a(c).bitwiseXOR(b(c))) for c in _SKETCH))
    return sizes & common & (apart <= most_apart(threshold, a("all") + b("all")))


def links(members: DataFrame, sets: Sets, threshold: float, mean_size: float = 500.0) -> DataFrame | None:
    """Labels (node, label) of the classes that the pairs within buckets (bucket, node) form by a Jaccard similarity of threshold or more; None if no pair is linked."""
    reach = 1 - threshold + 1e-9
    nodes = materialize(members.select("node").distinct(), "link-nodes")
    bounds = sets.bounds(nodes, int(mean_size * nodes.count()))
    sized = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")), "bucket")
    central = materialize(members.join(sized.groupBy("node").agg(F.sum("_n").alias("_central")), "node"), "link-central")
    first = central.groupBy("bucket").agg(F.max_by("node", F.struct(F.col("_central"), -F.col("node"))).alias("leader"))
    each = members.join(first, "bucket").where("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("_n"))
    home = each.groupBy("node").agg(F.max_by("leader", F.struct("_n", -F.col("leader"))).alias("leader"))
    of = lambda suffix: bounds.select(*(F.col(c).alias(c + suffix) for c in bounds.columns if c != "wide"))
    a, b = (lambda c: F.col(c + "_a")), (lambda c: F.col(c + "_b"))
    near = home.join(of("_a"), F.col("node") == F.col("node_a")).join(of("_b"), F.col("leader") == F.col("node_b")).where(may_link(threshold, a, b))
    done = sets.compared(near.select(F.col("node").alias("a"), F.col("leader").alias("b")), bounds, threshold)
    edges, labels, state, leaders = done.where(F.col("distance") <= reach).select("a", "b"), None, members, 32
    while True:
        labels = merged(labels, edges, "link-classes")
        if labels is None:
            state = state.withColumn("label", F.col("node"))
        else:
            state = state.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed_ = state.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("bucket")
        state = materialize(state.join(mixed_, "bucket", "left_semi"), "link-state")
        if state.isEmpty():
            return labels
        if "own" not in state.columns:
            state = state.join(bounds.select("node", "all", "own"), "node").withColumn("order", F.struct((F.col("own") / F.col("all")).alias("share"), "node"))
        # only those stay that could reach the threshold with the one of their bucket that has least of its own
        least = state.groupBy("bucket").agg(F.min("own").alias("_least"))
        state = state.join(least, "bucket").where(F.col("all") - F.col("own") >= threshold * (F.col("all") + F.col("_least")) - 1e-9).drop("_least")
        state = materialize(state, "link-state")
        ranked = state.withColumn("_rank", F.row_number().over(W.partitionBy("bucket").orderBy("order"))).where(F.col("_rank") <= leaders).drop("_rank")
        lead = materialize(ranked.select(*(F.col(c).alias(f"{c}_b") for c in state.columns)), "link-leaders")
        # sketches are wide: they are joined where pairs are bounded, and not kept with members
        drawn = state.join(bounds.select("node", *_SKETCH), "node")
        led = lead.join(of("_b").select("node_b", *(f"{c}_b" for c in _SKETCH)), "node_b")
        pairs = drawn.join(led, (F.col("bucket") == F.col("bucket_b")) & (F.col("label") != F.col("label_b")) & (F.col("order") > F.col("order_b")) & may_link(threshold, F.col, b))
        found = sets.compared(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct(), bounds, threshold)
        edges = found.where(F.col("distance") <= reach).select("a", "b")
        past = lead.groupBy(F.col("bucket_b").alias("bucket")).agg(F.max("order_b").alias("_last"))
        state = state.join(past, "bucket").where(F.col("order") > F.col("_last")).drop("label", "_last")
        leaders *= 16
