"""Operator 9: near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its shingles of five words: count times 1 + ln((1 + SMOOTH) / (f + SMOOTH)),
where f is the share of all rows that have the shingle. Every row's shingles are counted, into a table
of hashed counters (counters.py), where what a counter holds of other shingles is far below SMOOTH; the
table has a fixed size and is broadcast. SMOOTH keeps the unique shingles around an edit from outweighing those
that the copies share. Improved consistent weighted sampling draws HASHES samples from each set, with
variates taken from seeded tables by the shingle's hash; bands of samples form buckets. Within a bucket
every text is compared with its most central one, by the exact weighted Jaccard similarity of whole texts.
Further leaders follow, for the pairs that are neither in one class yet nor ruled out by the triangle
inequality of the distance or by the weight of shingles that only one of the texts has, until no such
pair is left. So each linked pair of a bucket ends up in one class, and a group of copies costs about
one comparison for each member. Classes are the connected parts.

Defined cases: null counts as empty; texts equal but for case, white space and punctuation are one
text from the start; texts without words form one class; texts of fewer than five words are one
shingle; null and repeated doc_ids are rows of their own; of a class the smallest doc_id (null last,
then the first row) stays; ties of samples go to the smaller hash, ties of leaders to the smaller row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.llm.common import kept_rows, located, materialize, merged, only_nodes, only_places, table, text_of, workspace
from sparkwell.llm.counters import count_rows, counter_of
from sparkwell.llm.hashing import mixed, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: Samples of a text, in bands of ROWS: a pair at the threshold meets in a bucket with probability 0.998, at 0.9 with 1 - 1e-5.
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
#: Added to each share of rows.
SMOOTH = 0.05
#: Rows of the variate tables. Shingles of one text that share a row are told apart by their hashes.
VARIATES = 1 << 13
SEED = 11

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's distinct shingles and how often each occurs, from the hashes of its words."""
    if not len(words):
        return words, np.empty(0, np.int64)
    n = max(1, len(words) - SHINGLE + 1)
    h = words[:n] * _FACTORS[0]
    for k in range(1, min(SHINGLE, len(words))):
        h += words[k:k + n] * _FACTORS[k]
    h = mixed(h)
    h.sort()
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], np.diff(np.append(first, n))


class Weights:
    """Weights of shingles by the corpus: its rows and the counters of its shingles."""

    def __init__(self, rows: int, counters: np.ndarray):
        share = np.minimum(counters / max(1, rows), 1.0)
        self.weight = (1 + np.log((1 + SMOOTH) / (share + SMOOTH))).astype(np.float32)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weigh(*shingles(next(word_hashes([text]))))

    def weigh(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return h, n * self.weight[counter_of(h)].astype(np.float64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard; two empty sets are equal."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum()) if len(both) else 0.0
    most = float(a[1].sum() + b[1].sum()) - least
    return least / most if most else 1.0


@lru_cache(maxsize=1)
def _variates(seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta of the sampling; r and c are gamma(2, 1), beta is uniform."""
    r = np.random.default_rng(seed)
    shape = (VARIATES, HASHES)
    return r.gamma(2.0, size=shape).astype(np.float32), np.log(r.gamma(2.0, size=shape)).astype(np.float32), r.random(shape).astype(np.float32)


def bands(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The bucket of a weighted set in each band; sets must not be empty, their hashes sorted."""
    r, log_c, beta = _variates()
    rows = (h >> np.uint64(64 - VARIATES.bit_length() + 1)).astype(np.int64)
    log_w = np.log(w).astype(np.float32)
    k = np.arange(HASHES)
    best = np.full(HASHES, np.inf, np.float32)
    sample, level = np.zeros(HASHES, np.uint64), np.zeros(HASHES, np.float32)
    for at in range(0, len(h), 2048):
        part = rows[at:at + 2048]
        rate, shift = r[part], beta[part]
        t = log_w[at:at + 2048, None] / rate
        t += shift
        np.floor(t, out=t)
        # ln a = ln c - ln y - r, where ln y = r (t - beta)
        shift -= t
        shift -= 1
        shift *= rate
        shift += log_c[part]
        low = shift.argmin(0)
        a, here = shift[low, k], h[at + low]
        better = (a < best) | ((a == best) & (here < sample))
        best, sample, level = np.where(better, a, best), np.where(better, here, sample), np.where(better, t[low, k], level)
    each = mixed(sample + level.astype(np.int64).view(np.uint64) * _FACTORS[0] + k.astype(np.uint64))
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = mixed(key * _FACTORS[1] + each[j::ROWS])
    return key.view(np.int64)


def corpus_weights(docs: DataFrame) -> Weights:
    """Weights by the shingles of all rows of docs."""
    return Weights(*count_rows(docs.select(text_of().alias("text")), lambda texts: (shingles(words)[0] for words in word_hashes(texts))))


def _signed(docs: DataFrame, weights) -> DataFrame:
    """doc_id, __sw_file, __sw_row, d1 and d2 (digest of the words), bands."""

    def sign(batches):
        w = weights.value
        for b in batches:
            d1, d2, keys = [], [], []
            for words in word_hashes(t.as_py() for t in b.column("text")):
                d = xxhash.xxh3_128_intdigest(words.tobytes())
                d1.append((d >> 64) - (1 << 63))
                d2.append((d & (1 << 64) - 1) - (1 << 63))
                keys.append(bands(*w.weigh(*shingles(words))).tolist() if len(words) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("__sw_file"), b.column("__sw_row"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "__sw_file", "__sw_row", "d1", "d2", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__sw_file", "__sw_row", text_of().alias("text"))
    return rows.mapInArrow(sign, "doc_id long, __sw_file string, __sw_row long, d1 long, d2 long, bands array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """a, b and the distance of each pair of nodes."""

    def compare(batches):
        w, last, theirs = weights.value, None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            d = []
            for k, node in enumerate(b):
                if node != last:  # pairs come in the order of b: its set is made once
                    last, theirs = node, w.of(batch.column("tb")[k].as_py())
                d.append(1 - similarity(w.of(batch.column("ta")[k].as_py()), theirs))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64())], ["a", "b", "distance"])

    pairs = materialize(pairs, "near-pairs")
    texts = only_nodes(texts, pairs)
    full = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b")
    return materialize(full.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, distance double"), "near-compared")


def _own_weights(nodes: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """node, all and own: the weight of a text's shingles, and of those that no other text of nodes has."""

    def explode(batches):
        w = weights.value
        for b in batches:
            for node, t in zip(b.column("node").to_pylist(), b.column("text"), strict=True):
                h, v = w.of(t.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), node)), pa.array(v, pa.float64())], ["hash", "node", "w"])

    each = texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(explode, "hash long, node long, w double")
    only = F.count(F.lit(1)) == 1

    counted = each.groupBy("hash").agg(only.alias("only"), F.min("node").alias("node"), F.sum("w").alias("w"))
    own = counted.where("only").groupBy("node").agg(F.sum("w").alias("own"))
    total = each.groupBy("node").agg(F.sum("w").alias("all"))
    return materialize(total.join(own, "node", "left").select("node", "all", F.coalesce("own", F.lit(0.0)).alias("own")), "near-own")


def links(members: DataFrame, compare: Callable[[DataFrame], DataFrame], own_weights: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame | None:
    """Labels (node, label) of the classes that the pairs within buckets (bucket, node) form; None if no pair is linked.

    compare gives pairs (a, b) their distance, which must be a metric: 1 - threshold links a pair.
    own_weights gives nodes their weight and the part of it that no other of these nodes has: what a
    pair has in common is at most the rest, which bounds its similarity without comparing it.

    First each bucket's members are compared with its most central one (that of the fullest buckets).
    Then, only for buckets whose members aren't all in one class, those with the least weight of their
    own lead, more of them in each round, for the pairs that lie in different classes and that neither
    bound rules out. A group of copies so needs about one comparison for each member.
    """
    reach = 1 - threshold + 1e-9
    sized = members.join(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")), "bucket")
    central = members.join(sized.groupBy("node").agg(F.sum("_n").alias("_central")), "node")
    first = central.groupBy("bucket").agg(F.max_by("node", F.struct(F.col("_central"), -F.col("node"))).alias("leader"))
    led = materialize(members.join(first, "bucket").where("node <> leader"), "near-led")
    done = compare(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct())
    edges = done.where(F.col("distance") <= reach).select("a", "b")
    state = led.join(done.withColumnsRenamed({"a": "node", "b": "leader"}), ["node", "leader"]).select("bucket", "node", "distance")
    leaders, labels = 32, None
    while True:
        labels = merged(labels, edges, "near-classes")
        if labels is None:
            state = state.withColumn("label", F.col("node"))
        else:
            state = state.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed_ = state.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("bucket")
        state = materialize(state.join(mixed_, "bucket", "left_semi"), "near-state")
        if state.isEmpty():
            return labels
        if "own" not in state.columns:
            own = own_weights(state.select("node").distinct()).withColumn("order", F.struct(F.try_divide("own", "all").alias("share"), "node")).withColumn("shared", F.col("all") - F.col("own"))
            buckets = materialize(state.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")), "near-buckets")
            state = state.join(own, "node").join(buckets, "node")
        # only those stay that could reach the threshold with the one of their bucket that has least of its own
        least = state.groupBy("bucket").agg(F.min("own").alias("_least"))
        state = state.join(least, "bucket").where(F.col("shared") >= threshold * (F.col("all") + F.col("_least")) - 1e-9).drop("_least")
        state = materialize(state, "near-state")
        ranked = state.withColumn("_rank", F.row_number().over(W.partitionBy("bucket").orderBy("order"))).where(F.col("_rank") <= leaders)
        lead = materialize(ranked.select(*(F.col(c).alias(f"{c}_b") for c in ("bucket", "node", "label", "distance", "own", "shared", "order", "buckets"))), "near-leaders")
        common, most = F.least("shared", "shared_b"), F.greatest("shared", "shared_b")
        pairs = state.join(lead, (
            (F.col("bucket") == F.col("bucket_b")) & (F.col("label") != F.col("label_b")) & (F.col("order") > F.col("order_b")) & (F.abs(F.col("distance") - F.col("distance_b")) <= reach)
            & (common >= threshold * (F.col("own") + F.col("own_b") + most) - 1e-9) & (F.col("bucket") == F.array_min(F.array_intersect("buckets", "buckets_b")))
        ))
        more = compare(pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())
        edges = more.where(F.col("distance") <= reach).select("a", "b")
        past = lead.groupBy(F.col("bucket_b").alias("bucket")).agg(F.max("order_b").alias("_last"))
        state = state.join(past, "bucket").where(F.col("order") > F.col("_last")).drop("label", "_last")
        leaders *= 16


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept, texts (different texts in the class), __sw_file, __sw_row."""
    spark = docs.sparkSession
    docs = located(docs).select("doc_id", "text", "__sw_file", "__sw_row")
    with workspace(spark, "near"):
        weights = spark.sparkContext.broadcast(corpus_weights(docs))
        rows = materialize(_signed(docs, weights).withColumn("row", F.monotonically_increasing_id()), "near-signed")
        nodes = materialize(rows.groupBy("d1", "d2").agg(F.min("row").alias("node")), "near-nodes")
        single = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
        members = single.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"))
        shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
        members = materialize(members.join(shared, "bucket", "left_semi"), "near-members")
        places = rows.join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select("__sw_file", "__sw_row", F.col("row").alias("node"))
        texts = materialize(only_places(docs.select("__sw_file", "__sw_row", text_of().alias("text")), materialize(places, "near-places")).select("node", "text"), "near-texts")
        labels = links(members, lambda pairs: _compared(pairs, texts, weights), lambda nodes: _own_weights(nodes, texts, weights), threshold)
        return named(rows, nodes, labels, ["d1", "d2"])


def named(rows: DataFrame, nodes: DataFrame, labels: DataFrame | None, key: list[str]) -> DataFrame:
    """rows with the class of their node (found by key) instead of key and row: class_id, class_size, kept, texts; a table that outlives the workspace."""
    nodes = nodes.withColumn("label", F.col("node")) if labels is None else nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # tables of their own, so that the joins with them may split a text or a class that many rows have
    own = rows.drop("bands", "prefix").join(materialize(nodes, "named-nodes"), key)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "row")).alias("_best")
    groups = own.groupBy("label", "node").agg(best, F.count(F.lit(1)).alias("_n")).groupBy("label").agg(F.min("_best").alias("_best"), F.sum("_n").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    found = own.join(materialize(groups, "named-groups"), "label")
    chosen = [F.col("_best.doc_id").alias("class_id"), "class_size", (F.col("_best.row") == F.col("row")).alias("kept"), "texts"]
    return materialize(found.select(*(c for c in own.columns if c not in (*key, "row", "node", "label")), *chosen), "classes", outlives=True)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class; the columns stay."""
    return kept_rows(docs, lambda rows: classes(rows, threshold))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).drop("__sw_file", "__sw_row")
