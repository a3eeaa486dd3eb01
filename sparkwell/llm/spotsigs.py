"""Operator 7: document fingerprints by spot signatures.

A signature is a common word (the anchor) with the CHAIN content words that follow it; common words
in between are skipped. A text's fingerprint is the set of its signatures' hashes, written as the
base64 of sorted 64-bit numbers. Two fingerprints are compared by Jaccard similarity; sets whose
sizes alone rule the threshold out aren't intersected.

Classes of similar texts come from partitions by set length: sets whose sizes are within the threshold
of each other lie in the same or in neighbouring classes of the logarithm of the size, and within a
partition sets meet on their rarest signatures only, as many as a set that reaches the threshold must
share one of. A signature is the rarer, the fewer rows have the words of its chain, counted over all rows
(counters.py): any order gives the same classes, and a rare one keeps unlike texts apart. Signatures that only one
set meets with are left behind before they move (sharing.py); what meets is compared on the exact sets (linking.py).

Defined cases: null text is empty; a text without any signature has one, of all its words together, so
that equal texts have equal fingerprints, and texts without words share one fingerprint; likeness of
equal fingerprints is 1; documents follow each other by descending doc_id, null last, equal ids by
a hash of the text and its place; a single document follows itself; of a class the smallest doc_id
(null last) names it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import located, materialize, table, text_of, workspace
from sparkwell.llm.counters import Tally, counter_of, summed
from sparkwell.llm.hashing import mixed, word_blocks
from sparkwell.llm.linking import Sets, links
from sparkwell.llm.near_dedup import named
from sparkwell.llm.sharing import Wanted, file_numbers, nodes_of, shared_keys, sliced

CHAIN = 2
THRESHOLD = 0.8

# Common words of the four languages, the anchors.
COMMON = frozenset(
    """the of and to in is that for it as was with be by on not he his her at from are this have an they which or had you but a
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es werden aus er hat dass sie nach wird bei
    de la le et les un du une que est pour qui dans par plus pas au sur ne se ce il elle avec son
    el y los del las por con no una su para al lo como más pero sus le ya o este sí porque""".split()
)

_F = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def _common() -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the common words, sorted, and which low bits they have."""
    known = np.sort(np.concatenate([h for h, _ in word_blocks(COMMON)]))
    low = np.zeros(1 << 16, bool)
    low[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
    return known, low


def _is_common(words: np.ndarray) -> np.ndarray:
    known, low = _common()
    common = low[(words & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(common)
    common[at] = known[np.minimum(np.searchsorted(known, words[at]), len(known) - 1)] == words[at]
    return common


def distinct(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of hashes, sorted for each text, differ from those before them in their text, and how many each text has."""
    ends = np.cumsum(sizes)
    new = np.append(True, h[1:] != h[:-1])[:len(h)]
    new[(ends - sizes)[sizes > 0]] = True
    upto = np.append(0, np.cumsum(new))
    return new, upto[ends] - upto[ends - sizes]


def spans(sizes: np.ndarray) -> list[tuple[int, int]]:
    ends = np.cumsum(sizes)
    return list(zip((ends - sizes).tolist(), ends.tolist(), strict=True))


def signed(words: np.ndarray, counts: np.ndarray, chain: int = CHAIN, rarity: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct signatures of each text of a block, from the hashes of its words and how many each text has; the sum of the
    rarity of their chains' words (nothing without rarity), and how many signatures each text has, at least one."""
    common = _is_common(words)
    content, anchors = np.flatnonzero(~common), np.flatnonzero(common)
    before = np.append(0, np.cumsum(~common))  # content words before each word
    of = np.repeat(np.arange(len(counts)), counts)[anchors]
    next_content = before[anchors]
    ok = next_content + chain <= before[np.cumsum(counts)][of]
    anchors, next_content, of = anchors[ok], next_content[ok], of[ok]
    s, weight = words[anchors] * _F[0], np.zeros(len(anchors))
    for k in range(chain):
        w = words[content[next_content + k]]
        s = mixed(s * _F[1] + w * _F[2])
        if rarity is not None:
            weight += rarity[counter_of(w)]
    n = np.bincount(of, minlength=len(counts))
    without = n == 0
    sizes = np.maximum(n, 1)
    if without.any():  # all words together
        at = np.repeat(without, sizes)
        some, s = s, np.empty(len(at), np.uint64)
        s[~at] = some
        s[at] = [xxhash.xxh3_64_intdigest(words[a:b].tobytes()) for (a, b), none in zip(spans(counts), without.tolist(), strict=True) if none]
        some, weight = weight, np.zeros(len(at))
        weight[~at] = some
    if rarity is None:
        for a, b in spans(sizes):
            s[a:b].sort()
        weight = None
    else:
        order = np.concatenate([a + np.argsort(s[a:b]) for a, b in spans(sizes)])
        s, weight = s[order], weight[order]
    new, sizes = distinct(s, sizes)
    return s[new], weight if weight is None else weight[new], sizes


def signatures(texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The sorted signatures of each text."""
    for words, counts in word_blocks(texts):
        s, _, sizes = signed(words, counts)
        for a, b in spans(sizes):
            yield s[a:b]


def written(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two signature sets; 0 where their sizes show that it is below least."""
    few, many = sorted((len(a), len(b)))
    if few < least * many:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (few + many - both)


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as much of the beginning of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def prefix_size(n: int, threshold: float) -> int:
    """How many signatures of a set of n, in any fixed order, hold one that it shares with each set of likeness of threshold or more.

    Such a pair shares at least threshold / (1 + threshold) of both sizes together. The smaller set may be as
    large as the other and needs n - ceil(2 threshold / (1 + threshold) n) + 1; the larger one needs these.
    """
    return n - math.ceil(threshold * n - 1e-9) + 1


def _order(rows: DataFrame) -> dict[str, Column]:
    """key and tie: what located rows are ordered by."""
    return {"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "tie": F.xxhash64(text_of(), "__sw_file", "__sw_row")}


_FULL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long, class_size long"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]


def packed(texts: pa.Array) -> pa.Array:
    """Texts as they are moved."""
    return pa.array([pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in texts.cast(pa.binary())], pa.binary())


def unpacked(data: bytes, n_bytes: int) -> str:
    return pa.decompress(data, n_bytes, codec="zstd", asbytes=True).decode()


def _prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order, each after the row of its class (no text), if there are classes, and before the one that follows it; guests are only followers."""
    names = [x.split()[0] for x in _FULL.split(", ")]
    last, own, judged = None, None, (None, None)  # the row before, its signatures and class
    coming = (None, None)  # class of the row that comes
    for b in batches:
        for at in range(0, b.num_rows, 512):
            rows = b.slice(at, 512).to_pylist()
            texts = [r for r in rows if r["packed"] is not None]
            for r in texts:
                r["text"] = unpacked(r["packed"], r["n_bytes"])
            prints = signatures([r["text"] for r in texts])
            changes = []  # pairs of rows that follow each other
            for r in rows:
                if r["packed"] is None:
                    coming = r["class_id"], r["class_size"]
                    continue
                sigs = next(prints)
                if last and last["part"] == r["part"] and not last["guest"]:
                    changes.append((last, own, judged, r, sigs))
                last, own, judged, coming = r, sigs, coming, (None, None)
            others = [edited(x["text"], y["text"]) for x, _, _, y, _ in changes]
            out = [
                (x["doc_id"], len(x["text"]), hashlib.sha256(other.encode()).hexdigest(), written(mine), written(changed), likeness(mine, changed), likeness(mine, theirs), *group)
                for (x, mine, group, _, theirs), other, changed in zip(changes, others, signatures(others), strict=True)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names)


def fingerprints(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: its fingerprint and that of its edited text, and how alike they and the next document's are.

    Documents are dealt by ranges of (id, tie); the first of each range also goes to the range before
    it, as a guest, so that each document meets the next one without a global order in one task.
    groups (key, tie, class_id, class_size) of the same rows are dealt alike, so that texts move once, each compressed.
    """
    spark = docs.sparkSession
    docs = located(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *(c.alias(n) for n, c in _order(docs).items()))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a random sample of a fixed size for each part gives the bounds of the ranges
    sample = rows.select("key", "tie").orderBy(F.xxhash64("key", "tie")).limit(32 * parts).collect()
    places = np.array(sorted((r.key, r.tie) for r in sample), [("key", "i8"), ("tie", "i8")])
    bounds = np.unique(places[[len(places) * k // parts for k in range(1, parts)]]) if len(places) else places

    def parts_of(keys, ties) -> np.ndarray:
        at = np.empty(len(keys), bounds.dtype)
        at["key"], at["tie"] = keys, ties
        return len(bounds) - np.searchsorted(bounds, at, side="left").astype(np.int32)

    @F.arrow_udf("int")
    def part_of(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(parts_of(keys.to_numpy(), ties.to_numpy()), pa.int32())

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            own = pa.array(parts_of(b.column("key").to_numpy(), b.column("tie").to_numpy()), pa.int32())
            part = pc.coalesce(b.column("part"), own)  # a guest comes with the part that it visits
            yield pa.RecordBatch.from_arrays([part, *(b.column(c) for c in keep), packed(b.column("text"))], ["part", *keep, "packed"])

    keep = ["guest", "key", "tie", "doc_id", "n_bytes"]
    heads = rows.select("key", "tie", part_of("key", "tie").alias("part")).groupBy("part").agg(F.max(F.struct("key", "tie")).alias("head")).orderBy("part").collect()  # one for each range
    if not heads:
        return spark.createDataFrame([], _FULL)
    before = [(heads[k - 1].part, h.head.key, h.head.tie) for k, h in enumerate(heads)]  # the first range's head follows the last
    guests = F.broadcast(spark.createDataFrame(before, "part int, key long, tie long"))
    guest = rows.join(guests, ["key", "tie"]).dropDuplicates(["key", "tie", "part"]).select(*rows.columns, "part", F.lit(True).alias("guest"))
    none = [F.lit(None).cast("long").alias(c) for c in ("class_id", "class_size")]
    every = rows.select("*", F.lit(None).cast("int").alias("part"), F.lit(False).alias("guest")).unionByName(guest)
    every = every.withColumn("n_bytes", F.octet_length("text")).mapInArrow(deal, "part int, guest boolean, key long, tie long, doc_id long, n_bytes int, packed binary").select("*", *none)
    if groups is not None:
        own = groups.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("n_bytes"), F.lit(None).cast("binary").alias("packed"), "key", "tie", part_of("key", "tie").alias("part"), F.lit(False).alias("guest"), "class_id", "class_size")
        every = every.unionByName(own)
    dealt = every.repartitionById(len(bounds) + 1, F.col("part"))
    order = ["part", "guest", F.desc("key"), F.desc("tie"), F.col("packed").isNotNull()]
    return dealt.sortWithinPartitions(*order).select("part", "guest", "doc_id", "n_bytes", "packed", "class_id", "class_size").mapInArrow(_prints, _FULL)


def level_of(size: int, threshold: float) -> int:
    """Sets that reach the threshold lie in one level or in neighbouring ones."""
    return math.floor(math.log(size) / (-math.log(threshold) if threshold < 1 else 1.0))


def meeting_keys(sigs: np.ndarray, weight: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Where sets meet their partners, and the set of each key: a set's rarest signatures in the partition of its own level and, as the smaller of a pair, fewer of them in the next."""
    own, below, levels = [], [], []
    for a, b in spans(sizes):
        n = b - a
        rarest = a + np.argsort(-weight[a:b], kind="stable")[: prefix_size(n, threshold)]
        own.append(rarest)
        below.append(rarest[: n - math.ceil(2 * threshold / (1 + threshold) * n - 1e-9) + 1])
        levels.append(level_of(n, threshold) + 1)
    sets = np.concatenate([np.repeat(np.arange(len(sizes)), [len(x) for x in some]) for some in (own, below)])
    level = np.array(levels, np.uint64)[sets]
    chosen = np.concatenate([*own, *below])
    level[len(chosen) - sum(map(len, below)):] += np.uint64(1)
    return mixed(sigs[chosen] + mixed(level * _F[0])), sets


_ROWS = "doc_id long, __sw_file string, __sw_row long, key long, tie long, d1 long, d2 long, size long, row long"
_COUNTED = "part int, rows long, width int, counters binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _rows(docs: DataFrame, numbers) -> DataFrame:
    """Rows of _ROWS (row names the row, d1 and d2 are the digest of its signatures), and among them those of _COUNTED: counters of the words of all rows."""
    names = _names(f"{_ROWS}, {_COUNTED}")
    types = [pa.int64(), pa.string(), *[pa.int64()] * 7, pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for b in sliced(batches):
            d1, d2, size = [], [], []
            for words, counts in word_blocks(b.column("text").to_pylist()):
                s, _, sizes = signed(words, counts)
                for start, end in spans(sizes):
                    d = xxhash.xxh3_128_intdigest(s[start:end].tobytes())
                    d1.append((d >> 64) - (1 << 63))
                    d2.append((d & (1 << 64) - 1) - (1 << 63))
                size += sizes.tolist()
                for start, end in spans(counts):
                    words[start:end].sort()
                tally.add(words[distinct(words, counts)[0]])
            tally.rows += b.num_rows
            own = [*(b.column(c) for c in ("doc_id", "__sw_file", "__sw_row", "key", "tie")), *(pa.array(x, pa.int64()) for x in (d1, d2, size, nodes_of(b, numbers.value)))]
            yield pa.RecordBatch.from_arrays(own + [pa.nulls(b.num_rows, t) for t in types[len(own):]], names)
        for part in tally.batches():
            nulls = [pa.nulls(part.num_rows, t) for t in types[: len(types) - part.num_columns]]
            yield pa.RecordBatch.from_arrays(nulls + part.columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__sw_file", "__sw_row", text_of().alias("text"), *(c.alias(n) for n, c in _order(docs).items()))
    return rows.mapInArrow(sign, f"{_ROWS}, {_COUNTED}")


def matches(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, key, tie, class_id (smallest doc_id among texts linked by likeness of threshold or more), class_size, kept, texts, __sw_file, __sw_row."""
    spark = docs.sparkSession
    docs = located(docs)
    texts = docs.select("__sw_file", "__sw_row", text_of().alias("text"))
    with workspace(spark, "spot"):
        numbers = spark.sparkContext.broadcast(file_numbers(docs))
        found = materialize(_rows(docs, numbers), "spot-rows")
        rows = found.where("part is null").select(*_names(_ROWS))
        n_rows, counted = summed(found.where("part is not null").select(*_names(_COUNTED)))
        rarity = spark.sparkContext.broadcast(-np.log((counted + 1) / (n_rows + 1)).astype(np.float32))  # of the size of the counters
        nodes = materialize(rows.groupBy("d1", "d2").agg(F.min("row").alias("node"), F.first("size").alias("size")), "spot-nodes")
        total, mean = nodes.agg(F.sum(F.ceil(F.col("size") * (1 - threshold) * 2) + 2), F.avg("size")).first()

        def wanted(chosen: DataFrame) -> Wanted:
            return Wanted(texts, numbers, chosen, n_rows, lambda: rows.join(chosen, F.col("row") == F.col("node"), "left_semi").select("__sw_file", "__sw_row", F.col("row").alias("node")))

        def keys_of(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Keys of texts, block by block, distinct in each text, and the text of each."""
            at = 0
            for words, counts in word_blocks(some):
                keys, sets = meeting_keys(*signed(words, counts, rarity=rarity.value), threshold)
                yield keys, sets + at
                at += len(counts)

        none = np.empty(0, np.uint64)
        source = wanted(nodes.select("node"))
        sent = spark.sparkContext.broadcast(shared_keys(source, lambda some: ((k, np.ones(len(k), bool), none) for k, _ in keys_of(some)), int(total or 0)))

        def meet(batches):
            for nodes_, some in source.texts(batches):
                for keys, sets in keys_of(some):
                    keep = sent.value.has(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(nodes_[sets[keep]])], ["bucket", "node"])

        members = materialize(source.df.mapInArrow(meet, "bucket long, node long"), "spot-keys")
        shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
        members = materialize(members.join(shared, "bucket", "left_semi"), "spot-members")
        labels = links(members, Sets(wanted, signatures), threshold, mean or 1.0)
        return named(rows.drop("size"), nodes.drop("size"), labels, ["d1", "d2"])


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = located(table(spark, sf_dir, "documents"))
    return fingerprints(docs, matches(docs))
