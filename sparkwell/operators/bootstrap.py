"""Paired bootstrap at any number of rounds, without a row for each round.

A pair's weight in a round is Poisson(1), found from a hash of its key and the round: so draws don't depend on how rows are dealt,
and any task can make them again. Tasks draw the weights of a block of pairs for all rounds at once and add up, for each round,
what statistics need: weights, weighted differences, and the weight below two bounds around each quantile. The bounds
are chosen so wide that each round's quantile lies between them (checked, and widened if not); only the pairs between them,
some multiple of the square root of all, are then weighed one by one, sorted by value, by tasks that take rounds each.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.plans.views import oracle, view
from sparkwell.shared import written

# The steps of the 64-bit mixing function, and Poisson(1) in 65,536ths: a draw of 16 bits counts the steps that it reaches.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CDF = [round(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8)]
_WEIGHT = np.searchsorted(np.array(CDF), np.arange(65536), "right").astype(np.uint8)

#: Pairs whose weights are drawn at once, and weights of sorted pairs that a task holds.
BLOCK, HELD = 256, 1 << 22
#: Pairs between the bounds that are sent to all tasks (16 bytes each); more are weighed where they lie.
SENT = 2_000_000


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_2)
    return z ^ (z >> np.uint64(31))


def seeds(keys: np.ndarray) -> np.ndarray:
    return _mixed(keys.astype(np.int64).view(np.uint64) + np.uint64(STEP))


def weights(seed: np.ndarray, first: int, last: int) -> np.ndarray:
    """How often each pair is drawn in rounds first to last - 1, as rows of bytes."""
    blocks = np.arange(first // 4, (last + 3) // 4, dtype=np.uint64)
    h = _mixed(seed[:, None] + (blocks + np.uint64(1)) * np.uint64(STEP))
    drawn = _WEIGHT[h.astype("<u8").view("<u2")]
    return drawn[:, first % 4: first % 4 + last - first]


class Quantile:
    """A quantile of a column in each round, and the bounds between which it is looked for."""

    def __init__(self, column: str, q: float):
        self.column, self.q, self.low, self.high = column, q, -math.inf, math.inf


def _bounded(pairs: DataFrame, wanted: list[Quantile], n: int, widen: float) -> None:
    """Bounds so many ranks around each quantile that no round is likely to leave them; what they hold is exact wherever they lie."""
    accuracy = 1_000_000 if n > 1_000_000 else 10_000
    at = {}
    for w in wanted:
        margin = widen * (7 * math.sqrt(max(w.q * (1 - w.q), 1e-4) / n) + 2 / accuracy)
        at[w] = [w.q - margin, w.q + margin]
    found = pairs.agg(*(F.percentile_approx(w.column, [min(1.0, max(0.0, x)) for x in at[w]], accuracy).alias(f"_{k}") for k, w in enumerate(wanted))).first()
    for k, w in enumerate(wanted):
        w.low = found[k][0] if at[w][0] > 0 else -math.inf
        w.high = found[k][1] if at[w][1] < 1 else math.inf


def _sums(pairs: DataFrame, before: str, after: str, wanted: list[Quantile], rounds: int) -> DataFrame:
    """round, n (weight of all pairs), mean (of after - before), and below_k and upto_k: the weight under the lower bound of the k-th quantile, and up to its upper one."""
    names = ["n", "total", *(f"{s}_{k}" for k in range(len(wanted)) for s in ("below", "upto"))]
    spec = [(w.column, w.low, w.high) for w in wanted]

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(names), rounds))
        seen = False
        for b in batches:
            seed = seeds(b.column("_key").to_numpy())
            value = {c: b.column(c).to_numpy() for c in {before, after}}
            parts = [np.ones(len(seed)), value[after] - value[before]]
            for c, low, high in spec:
                parts += [value[c] < low, value[c] <= high]
            parts = np.vstack(parts).astype(np.float64)
            for at in range(0, len(seed), BLOCK):
                seen = True
                for r in range(0, rounds, 2048):
                    to = min(rounds, r + 2048)
                    totals[:, r:to] += parts[:, at:at + BLOCK] @ weights(seed[at:at + BLOCK], r, to).astype(np.float64)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rounds)), *map(pa.array, totals)], ["round", *names])

    each = pairs.mapInArrow(add, ", ".join(["round long", *(f"{c} double" for c in names)]))
    return each.groupBy("round").agg(*(F.sum(c).alias(c) for c in names)).select("round", "n", (F.col("total") / F.col("n")).alias("mean"), *names[2:])


def _ranks(n, q: float):
    h = q * (n - 1)
    return F.floor(h) + 1, F.least(F.floor(h) + 2, n), h - F.floor(h)


def _picked(pairs: DataFrame, sums: DataFrame, wanted: Quantile, k: int, rounds: int) -> DataFrame:
    """round and the k-th quantile in it, exactly."""
    low, high, part = _ranks(F.col("n"), wanted.q)
    ranks = sums.select("round", F.col(f"below_{k}").alias("below"), low.alias("low"), high.alias("high"), part.alias("part"))
    inside = pairs.where((F.col(wanted.column) >= wanted.low) & (F.col(wanted.column) <= wanted.high)).select("_key", F.col(wanted.column).alias("value"))
    count = inside.count()
    if count <= SENT:
        got = inside.toArrow()
        value = got.column("value").to_numpy()
        order = np.argsort(value, kind="stable")
        sent = pairs.sparkSession.sparkContext.broadcast((seeds(got.column("_key").to_numpy())[order], value[order]))
        step = max(4, min(256, HELD // max(1, count)) // 4 * 4)  # rounds of a task

        def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seed, values = sent.value
            for b in batches:
                rows = sorted(zip(*(b.column(c).to_pylist() for c in ("round", "below", "low", "high", "part")), strict=True))
                at = 0
                while at < len(rows):
                    first = rows[at][0]
                    group = [r for r in rows[at:at + step] if r[0] < first + step]
                    at += len(group)
                    drawn = weights(seed, first, group[-1][0] + 1)[:, [r[0] - first for r in group]]
                    upto = np.cumsum(drawn, axis=0, dtype=np.int32)
                    a, b_ = (values[(upto < np.array([r[c] - r[1] for r in group])).sum(0)] for c in (2, 3))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in group], pa.int64()), pa.array(a + (b_ - a) * np.array([r[4] for r in group]))], ["round", "value"])

        parts = max(1, min(-(-rounds // step), 8 * pairs.sparkSession.sparkContext.defaultParallelism))
        dealt = ranks.repartitionByRange(parts, "round").sortWithinPartitions("round")
        return dealt.mapInArrow(pick, "round long, value double").withColumnRenamed("value", f"q_{k}")

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, where = np.unique(b.column("value").to_numpy(), return_inverse=True)
            seed = seeds(b.column("_key").to_numpy())
            for r in range(0, rounds, 64):
                drawn = weights(seed, r, min(rounds, r + 64))
                for j in range(drawn.shape[1]):
                    w = np.bincount(where, drawn[:, j], len(value))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), r + j)), pa.array(value), pa.array(w)], ["round", "value", "weight"])

    each = inside.mapInArrow(weigh, "round long, value double, weight double").where("weight > 0").groupBy("round", "value").agg(F.sum("weight").alias("weight"))
    upto = each.withColumn("upto", F.sum("weight").over(W.partitionBy("round").orderBy("value").rowsBetween(W.unboundedPreceding, 0))).join(ranks, "round")
    at = lambda rank: F.min(F.when(F.col("below") + F.col("upto") >= F.col(rank), F.col("value")))
    return upto.groupBy("round").agg(at("low").alias("a"), at("high").alias("b"), F.first("part").alias("part")).select("round", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias(f"q_{k}"))


def bootstrap_rounds(pairs: DataFrame, key: str, before: str, after: str, rounds: int, columns: list[tuple[str, float]]) -> DataFrame:
    """round, n, mean (of after - before) and q_0, q_1, ...: the quantiles (column, q) of each round, between ranks, exactly.

    Pairs with a null or no number are left out; keys name pairs (equal keys are drawn together). A round that draws no pair has no row.
    """
    spark = pairs.sparkSession
    number = [F.col(c).cast("double").alias(c) for c in dict.fromkeys((before, after))]
    kind = dict(pairs.dtypes)[key]
    named = F.col(key).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    rows = pairs.select(named.alias("_key"), *number)
    rows = rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in (before, after))).where("_key is not null")
    rows = written(rows.repartition(spark.sparkContext.defaultParallelism), "bootstrap-pairs")
    n = rows.count()
    wanted = [Quantile(c, q) for c, q in columns]
    if not n:
        return spark.createDataFrame([], ", ".join(["round long", "n double", "mean double", *(f"q_{k} double" for k in range(len(wanted)))]))
    widen = 1.0
    while True:
        _bounded(rows, wanted, n, widen)
        sums = written(_sums(rows, before, after, wanted, rounds).where("n > 0"), "bootstrap-sums")
        misses = F.lit(False)
        for k, w in enumerate(wanted):
            low, high, _ = _ranks(F.col("n"), w.q)
            misses = misses | (F.col(f"below_{k}") >= low) | (F.col(f"upto_{k}") < high)
        if sums.where(misses).isEmpty():
            break
        widen *= 2
    out = sums.select("round", "n", "mean")
    for k, w in enumerate(wanted):
        out = out.join(_picked(rows, sums, w, k, rounds), "round")
    return out


def paired_bootstrap(pairs: DataFrame, key: str, before: str, after: str, rounds: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """One row: rounds, and percentile intervals of the mean of after - before, of the difference of their medians and of the ratio of their 95th percentiles."""
    each = bootstrap_rounds(pairs, key, before, after, rounds, [(before, 0.5), (after, 0.5), (before, 0.95), (after, 0.95)])
    each = each.select("mean", (F.col("q_1") - F.col("q_0")).alias("median"), F.try_divide("q_3", "q_2").alias("ratio"))
    ends = F.array(F.lit((1 - confidence) / 2), F.lit((1 + confidence) / 2))
    both = each.agg(F.count("*").alias("rounds"), *(F.percentile(c, ends).alias(c) for c in each.columns))  # one row for each round
    return both.select("rounds", *(F.round(F.col(c)[k], 6).alias(f"{c}_{end}") for c in each.columns for k, end in enumerate(("low", "high"))))


def evl08_bootstrap(spark, sf_dir):
    """All turns under two systems: as measured, and a second one that is faster by a share of its own for each turn."""
    after = F.col("model_seconds") * (2 + F.col("turn_id") % 7 / 10)
    return paired_bootstrap(view(spark, sf_dir, "turns").select("turn_id", "seconds", after.alias("after")), "turn_id", "seconds", "after")


QUERIES = {"evl08_bootstrap": evl08_bootstrap}

_MASK = "18446744073709551615::uhugeint"


def _mix_sql(source: str, z: str, name: str, keep: str) -> str:
    """Columns keep and name, the mixing function of z, of a source; 64 bits are held in 128."""
    one = f"select {keep}, (xor(z, z >> 30) * {MIX_1}::uhugeint) & {_MASK} as y from (select {keep}, ({z}) & {_MASK} as z from {source})"
    two = f"select {keep}, (xor(y, y >> 27) * {MIX_2}::uhugeint) & {_MASK} as x from ({one})"
    return f"select {keep}, xor(x, x >> 31) as {name} from ({two})"


def _drawn_sql(source: str, keep: str) -> str:
    """Columns keep, r and w (not 0): how often each row of a source (key, keep) is drawn in each of 10,000 rounds."""
    mixed = _mix_sql(f"({_mix_sql(source, f'key::uhugeint + {STEP}::uhugeint', 'seed', 'key, ' + keep)}), range(2500) as g(blk)", f"seed + (blk + 1)::uhugeint * {STEP}::uhugeint", "h", f"blk, {keep}")
    halves = ", ".join(f"((h >> {16 * j}) & 65535::uhugeint)::int" for j in range(4))
    weight = " + ".join(f"(u >= {c})::int" for c in CDF if c < 65536)
    return f"select {keep}, r, w from (select {keep}, 4 * blk + j as r, {weight} as w from (select {keep}, blk, unnest([{halves}]) as u, unnest([0, 1, 2, 3]) as j from ({mixed}))) where w > 0"


def _interval_sql() -> str:
    wanted = [("a", 0.5), ("b", 0.5), ("a", 0.95), ("b", 0.95)]
    ctes = ["p as (select turn_id as key, seconds as a, model_seconds * (2 + turn_id % 7 / 10) as b from turns where seconds is not null and model_seconds is not null)"]
    ctes.append("o as (select a, b, row_number() over (order by a) as ia, row_number() over (order by b) as ib, count(*) over () as m from p)")
    edge = lambda c, q, sign: f"floor(m * ({q} {sign} 7 * sqrt({q * (1 - q)} / m)))"
    bounds = (f"min({c}) filter (where i{c} >= {edge(c, q, '-')}) as lo{k}, max({c}) filter (where i{c} <= {edge(c, q, '+')} + 1) as hi{k}" for k, (c, q) in enumerate(wanted))
    ctes.append(f"e as (select {', '.join(bounds)} from o)")
    ctes.append("f as materialized (select key, b - a as d, " + ", ".join(f"({c} < lo{k})::int as l{k}" for k, (c, _) in enumerate(wanted)) + " from p, e)")
    ctes.append("s as materialized (select r, sum(w) as n, sum(w * d) / sum(w) as mean, " + ", ".join(f"sum(w * l{k}) as l{k}" for k in range(4)) + f" from ({_drawn_sql('f', 'd, l0, l1, l2, l3')}) group by r)")
    for k, (c, q) in enumerate(wanted):
        ctes.append(f"t{k} as (select key, {c} as v from p, e where {c} between lo{k} and hi{k})")
        ctes.append(f"c{k} as (select r, v, sum(w) over (partition by r order by v rows unbounded preceding) as upto from ({_drawn_sql(f't{k}', 'v')}))")
        ctes.append(f"q{k} as (select r, lo + (hi - lo) * (h - floor(h)) as q{k} from (select r, {q} * (any_value(n) - 1) as h, min(v) filter (where l{k} + upto >= floor({q} * (n - 1)) + 1) as lo, min(v) filter (where l{k} + upto >= least(floor({q} * (n - 1)) + 2, n)) as hi from c{k} join s using (r) group by r))")
    ctes.append("z as (select mean, q1 - q0 as median, q3 / q2 as ratio from s join q0 using (r) join q1 using (r) join q2 using (r) join q3 using (r))")
    ends = ", ".join(f"round(quantile_cont({c}, {x}), 6) as {c}_{end}" for c in ("mean", "median", "ratio") for x, end in ((0.025, "low"), (0.975, "high")))
    return oracle("", "turns") + ", " + ", ".join(ctes) + f" select count(*) as rounds, {ends} from z"


SQL = {"evl08_bootstrap": _interval_sql()}
