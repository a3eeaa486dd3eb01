"""Measurements and evaluation: percentiles by three definitions, intervals, paired tests, gates, thresholds, splits."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import normalized_message
from sparkwell.plans.views import oracle, view
from sparkwell.shared import shared_dir, written

#: Two-sided 95 % normal quantile.
Z95 = 1.959963984540054


#: Ranges that the values of a group are dealt to.
RANGES = 64


def ranged(counts: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """counts (keys, value, weight) with _range, _before and _n: the range of the value within its keys, the weight of the ranges below it, and of all.

    The cuts are approximate quantiles of each group, so that a group of any size is spread over RANGES
    ranges; what comes from them is exact, wherever they lie.
    """
    same = keys or ["_all"]
    counts = counts if keys else counts.withColumn("_all", F.lit(0))
    quantiles = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    cuts = counts.groupBy(*same).agg(F.array_distinct(F.percentile_approx(value, quantiles, 20 * RANGES)).alias("_cuts"))
    dealt = counts.join(cuts, same).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    w = W.partitionBy(*same)  # at most RANGES rows
    sums = dealt.groupBy(*same, "_range").agg(F.sum(weight).alias("_m"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_m").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_m").over(w)})
    return dealt.join(sums, [*same, "_range"])


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]], weight: Column | None = None) -> DataFrame:
    """keys, n (weight of the values that aren't null) and picked, a map from rank to the value at that rank, from 1.

    ranks gives the ranks wanted from n. Values are counted first; then only the ranges that hold a
    wanted rank are ordered, each by itself. weight: how often a row counts (null: once).
    """
    same = keys or ["_all"]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.lit(1) if weight is None else weight).cast("long").alias("_c")).where("_c > 0")
    every = ranged(counts, keys, value, "_c").withColumn("_wanted", F.array_distinct(F.array(*(r.cast("long") for r in ranks(F.col("_n"))))))
    near = every.where(F.exists("_wanted", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_m"))))
    to = F.col("_before") + F.sum("_c").over(W.partitionBy(*same, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    hits = near.withColumn("_to", to).select(*same, "_n", value, F.explode(F.filter("_wanted", lambda r: (r > F.col("_to") - F.col("_c")) & (r <= F.col("_to")))).alias("_rank"))
    return hits.groupBy(*same).agg(F.max("_n").alias("n"), F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("picked")).select(*keys, "n", "picked")


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], kind: str = "linear", weight: Column | None = None) -> DataFrame:
    """keys, n and a column for each quantile wanted, exact at any size of a group.

    linear: between the two ranks around q (n - 1). nearest: rank ceil(q n). floor: rank
    floor(q (n - 1)) from 0. upper: rank floor(q n) from 0.
    """
    places = {
        "linear": lambda q, n: [F.floor(q * (n - 1)) + 1, F.least(F.floor(q * (n - 1)) + 2, n)],
        "nearest": lambda q, n: [F.greatest(F.lit(1), F.ceil(q * n))],
        "floor": lambda q, n: [F.floor(q * (n - 1)) + 1],
        "upper": lambda q, n: [F.least(F.floor(q * n) + 1, n)],
    }[kind]
    found = order_statistics(df, keys, value, lambda n: [r for q in wanted.values() for r in places(F.lit(q), n)], weight)

    def picked(q: float) -> Column:
        n = F.col("n")
        low, *high = [F.element_at("picked", r.cast("long")) for r in places(F.lit(q), n)]
        return low + (high[0] - low) * (q * (n - 1) - F.floor(q * (n - 1))) if high else low

    return found.select(*keys, "n", *(picked(q).alias(name) for name, q in wanted.items()))


def numbered(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """df with _rank and _n: its place by a distinct number within its keys, and the rows of these."""
    same = keys or ["_all"]
    rows = ranged(df.withColumn("_one", F.lit(1)), keys, by, "_one")
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*same, "_range").orderBy(by))
    return rows.withColumn("_rank", rank).select(*df.columns, "_rank", "_n")


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval, clamped to [0, 1]; null for n = 0."""
    p = F.try_divide(successes, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def rule_of_three(n: Column, confidence: float = 0.95) -> Column:
    """Upper bound of a rate of which none was seen in n; null for n = 0."""
    return F.when(n > 0, -F.ln(F.lit(1 - confidence)) / n)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact p-value of discordant counts: twice the binomial tail up to k = min(b, c), at any n.

    Summed downwards from its largest term, the k-th. The one j below it is at most exp(-2 j^2 / n) times as large,
    so that what lies beyond 5 sqrt(n) of them is below a double's precision.
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    start = F.struct(_half_binomial(n, k).alias("term"), F.lit(0.0).alias("total"))
    add = lambda acc, j: F.struct((acc["term"] * (k - j) / (n - k + j + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total"))
    parts = F.aggregate(F.sequence(F.lit(0), F.least(k, F.ceil(5 * F.sqrt(n))).cast("int")), start, add, lambda acc: acc["total"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * parts))


def _half_binomial(n: Column, k: Column) -> Column:
    """C(n, k) / 2^n of n > 0 and k <= n / 2: without rounding up to n = 50, then by the saddle point, where no large logarithms cancel."""
    choose = F.aggregate(F.sequence(F.lit(1), F.least(k, F.lit(25.0)).cast("int")), F.lit(1.0), lambda acc, i: acc * (n - k + i) / i)
    x = (n - 2 * k) / n
    deviance = n / 2 * ((1 - x) * F.log1p(-x) + (1 + x) * F.log1p(x))
    mass = F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - deviance)
    return F.when(k == 0, F.pow(F.lit(0.5), n)).when(n <= 50, choose * F.pow(F.lit(0.5), n)).otherwise(mass)


def _stirling_error(m: Column) -> Column:
    """ln m! less Stirling's formula, of m > 0."""
    small = F.ln(F.factorial(m.cast("int")).cast("double")) - (m + 0.5) * F.ln(m) + m - 0.5 * math.log(2 * math.pi)
    return F.when(m <= 20, small).otherwise((1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (m * m)) / (m * m)) / (m * m)) / m)


def trapezoid(times: str, values: str, key: str, df: DataFrame) -> DataFrame:
    """Integral of values over seconds by the trapezoid rule, for each key; null with fewer than two samples."""
    w = W.partitionBy(key).orderBy(times, values)
    at = F.unix_micros(F.col(times).cast("timestamp"))
    step = F.lead(at).over(w) - at
    area = (F.col(values) + F.lead(values).over(w)) / 2 * step / 1e6
    return df.select(key, area.alias("area")).groupBy(key).agg((F.sum("area") / 3600).alias("integral"))


def family_split(df: DataFrame, family: str, seed: str = "7", shares: tuple[float, float] = (0.6, 0.15), strata: list[str] | None = None) -> DataFrame:
    """family and split: whole families go to train, calibration or test, in the order of a seeded hash, by shares of the families of each stratum.

    The families are one row each and are ranked within hash ranges, whose sizes come from a count of
    ranges, so that no task has to order all of them.
    """
    order = F.sha1(F.concat_ws("|", F.lit(seed), F.col(family).cast("string")))
    same = strata or []
    cut = df.select(family, *same).distinct().withColumn("_key", order).withColumn("_range", F.substring("_key", 1, 2))
    sizes = cut.groupBy(*same, "_range").agg(F.count("*").alias("_m"))
    w = W.partitionBy(*same)  # 256 rows
    before = sizes.select(*same, "_range", F.sum("_m").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.sum("_m").over(w).alias("_n"))
    ranked = cut.join(before, [*same, "_range"]).withColumn("_rank", F.row_number().over(W.partitionBy(*same, "_range").orderBy("_key", family)) + F.coalesce("_before", F.lit(0)))
    train, cal = F.bround(shares[0] * F.col("_n")), F.bround(shares[1] * F.col("_n"))
    return ranked.select(family, *(strata or []), F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + cal, "calibration").otherwise("test").alias("split"))


def threshold_for(df: DataFrame, confidence: str, correct: str, target: float) -> DataFrame:
    """Lowest distinct confidence from which on precision reaches the target, with coverage and precision; none if never."""
    steps = df.groupBy(confidence).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("k")).where(F.col(confidence).isNotNull())
    # what lies at or above a confidence: the ranges above its own, then those of its range from the top down
    cut = ranged(steps, [], confidence, "n")
    right = cut.groupBy("_range").agg(F.sum("k").alias("_k"))
    above = right.select("_range", F.coalesce(F.sum("_k").over(W.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_right"))  # at most RANGES rows
    w = W.partitionBy("_range").orderBy(F.desc(confidence)).rowsBetween(W.unboundedPreceding, 0)
    upper = F.col("_n") - F.col("_before") - F.col("_m")
    cum = cut.join(above, "_range").select(confidence, (upper + F.sum("n").over(w)).alias("accepted"), (F.col("_right") + F.sum("k").over(w)).alias("right"), F.col("_n").alias("total"))
    ok = cum.where(F.col("right") >= target * F.col("accepted"))
    return ok.orderBy(confidence).limit(1).select(confidence, "accepted", F.round(F.col("accepted") / F.col("total"), 6).alias("coverage"), F.round(F.col("right") / F.col("accepted"), 6).alias("precision"))


def threshold_grid(df: DataFrame, confidence: str, correct: str, grid: list[float]) -> DataFrame:
    """Accepted, right and wrong at each threshold of a grid, in one pass over the rows: each row counts for the thresholds it reaches."""
    each = df.select(F.explode(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col(confidence))).alias("threshold"), F.col(correct).cast("int").alias("ok"))
    return each.groupBy("threshold").agg(F.count("*").alias("accepted"), F.sum("ok").alias("right"), F.sum(1 - F.col("ok")).alias("wrong"))


def _turns(spark, sf_dir):
    return view(spark, sf_dir, "turns")


def agg14_median(spark, sf_dir):
    return quantiles(_turns(spark, sf_dir), ["status"], "seconds", {"median": 0.5}).select("status", F.round("median", 6).alias("median"))


def agg15_percentiles(spark, sf_dir):
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return quantiles(_turns(spark, sf_dir), ["status"], "seconds", wanted).select("status", *(F.round(n, 6).alias(n) for n in wanted))


def agg16_nearest_rank(spark, sf_dir):
    return quantiles(_turns(spark, sf_dir), ["status"], "seconds", {"p95": 0.95}, "nearest").select("status", "p95")


def agg17_floor_index(spark, sf_dir):
    return quantiles(_turns(spark, sf_dir), ["session_id"], "seconds", {"p95": 0.95}, "floor").select("session_id", "p95")


def agg18_wall_summary(spark, sf_dir):
    t = _turns(spark, sf_dir)
    middle = quantiles(t, ["model_calls"], "seconds", {"median": 0.5, "p95": 0.95}).drop("n")
    ends = t.groupBy("model_calls").agg(F.count("*").alias("n"), F.min("seconds").alias("least"), F.max("seconds").alias("most"))
    return ends.join(middle, "model_calls", "left").select("model_calls", "n", *(F.round(n, 3).alias(n) for n in ("median", "p95", "least", "most")))


def agg19_stage_medians(spark, sf_dir):
    stages = F.create_map(F.lit("total"), F.col("seconds"), F.lit("model"), F.col("model_seconds"))
    each = _turns(spark, sf_dir).select(F.explode(stages).alias("stage", "s"))
    return quantiles(each, ["stage"], "s", {"median": 0.5}).select("stage", F.round("median", 6).alias("median"), "n")


def agg20_hit_rate(spark, sf_dir):
    hits, misses = F.count_if(F.col("status") == "view"), F.count_if(F.col("status") == "click")
    return _turns(spark, sf_dir).groupBy("session_id").agg(hits.alias("hits"), misses.alias("misses"), F.round(F.coalesce(F.try_divide(hits, hits + misses), F.lit(0.0)), 4).alias("rate"))


def agg02_stage_summary(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("status", "model_calls").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 1).alias("seconds"))


def agg26_call_counts(spark, sf_dir):
    other = _turns(spark, sf_dir).withColumn("other", F.col("seconds") - F.coalesce("model_seconds", F.lit(0.0)))
    middle = quantiles(other, ["model_calls"], "other", {"other": 0.5}).drop("n")
    return other.groupBy("model_calls").agg(F.count("*").alias("n")).join(middle, "model_calls", "left").select("model_calls", "n", F.round("other", 6).alias("other"))


def agg05_pass_by_group(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("ok", F.col("seconds") < 50)
    return t.groupingSets([["status"], ["model_calls"], []], "status", "model_calls").agg(F.count_if("ok").alias("passed"), F.count("*").alias("total"))


def agg06_rank_summary(spark, sf_dir):
    rr = F.when(F.col("rank").isNotNull(), 1 / F.col("rank"))
    t = _turns(spark, sf_dir).withColumn("rank", F.when(F.col("seconds") < 60, (F.col("turn_id") % 7 + 1)))
    return t.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("pass1"), F.count_if(F.col("rank") <= 3).alias("pass3"), F.round(F.avg(rr), 4).alias("mrr"), F.count(rr).alias("n_rr"))


def win13_eviction(spark, sf_dir):
    """Of each session's entries the most used stay while both the count and the size limit hold."""
    w = W.partitionBy("session_id").orderBy(F.desc("model_calls"), F.desc("turn_id")).rowsBetween(W.unboundedPreceding, 0)
    t = _turns(spark, sf_dir).withColumns({"n": F.count("*").over(w), "bytes": F.sum(F.col("seconds").cast("long")).over(w)})
    return t.where("n <= 30 and bytes <= 1200").groupBy("session_id").agg(F.count("*").alias("kept"), F.max("bytes").alias("bytes"))


def win16_energy(spark, sf_dir):
    return trapezoid("ts", "seconds", "session_id", _turns(spark, sf_dir)).select("session_id", F.round("integral", 4).alias("wh"))


def win17_counter(spark, sf_dir):
    """Counter readings that wrap at a limit: the sum of steps, a falling step counts the limit on top."""
    w = W.partitionBy("session_id").orderBy("ts", "turn_id")
    reading = F.col("turn_id") * 37 % 1000
    step = reading - F.lag(reading).over(w)
    return _turns(spark, sf_dir).select("session_id", F.when(step < 0, step + 1000).otherwise(step).alias("d")).groupBy("session_id").agg(F.sum("d").alias("delta"))


def win12_newest(spark, sf_dir):
    w = W.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn_id"))
    return _turns(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("session_id", "rn", "turn_id")


def win15_mode_order(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy(F.when((F.col("turn_id") + F.col("session_id") + F.col("model_calls")) % 2 == 0, "baseline first").otherwise("candidate first").alias("mode")).agg(F.count("*").alias("n"))


def evl03_engine_diff(spark, sf_dir):
    t = _turns(spark, sf_dir)
    a = t.where("model_calls = 1").groupBy("session_id").agg((F.avg("seconds") < 55).alias("before"))
    b = t.where("model_calls = 2").groupBy("session_id").agg((F.avg("seconds") < 55).alias("after"))
    change = F.when(F.col("before") & ~F.col("after"), "regressed").when(~F.col("before") & F.col("after"), "gained").otherwise("same")
    return a.join(b, "session_id", "full").select("session_id", change.alias("change"))


def evl04_status_quality(spark, sf_dir):
    expected = F.when(F.col("session_id") % 2 == 0, "view").otherwise("click")
    t = _turns(spark, sf_dir).withColumn("expected", expected)
    return t.groupBy("expected").agg(F.count_if(F.col("status") == F.col("expected")).alias("correct"), F.count_if((F.col("expected") == "click") & (F.col("status") == "view")).alias("false_hits"), F.count("*").alias("n"))


def evl05_mcnemar(spark, sf_dir):
    a, b = F.count_if((F.col("seconds") < 50) & (F.col("model_seconds") >= 10)), F.count_if((F.col("seconds") >= 50) & (F.col("model_seconds") < 25))
    return _turns(spark, sf_dir).groupBy("session_id").agg(a.alias("b"), b.alias("c")).select("session_id", "b", "c", F.round(mcnemar_exact(F.col("b"), F.col("c")), 8).alias("p"))


def evl06_wilson(spark, sf_dir):
    n = _turns(spark, sf_dir).groupBy("session_id").agg(F.count_if(F.col("status") == "view").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return n.select("session_id", "k", "n", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


def evl07_rule_of_three(spark, sf_dir):
    n = _turns(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return n.select("status", F.round(rule_of_three(F.col("n")), 10).alias("upper"), F.ceil(-F.ln(F.lit(0.05)) / 0.01).alias("needed"))


def evl09_gates(spark, sf_dir):
    t = _turns(spark, sf_dir)
    p95 = quantiles(t, ["status"], "seconds", {"p95": 0.95}).drop("n")
    g = t.groupBy("status").agg(F.count("*").alias("n")).join(p95, "status").select("status", (F.col("p95") <= 160).alias("speed"), (F.col("n") >= 300).alias("volume"))
    return g.select("status", F.when(F.col("speed") & F.col("volume"), "SHIP").when(F.col("speed") | F.col("volume"), "HOLD").otherwise("REJECT").alias("verdict"))


def evl12_threshold_grid(spark, sf_dir):
    t = _turns(spark, sf_dir).select((F.col("seconds") / 500).alias("confidence"), (F.col("status") == "view").alias("ok"))
    return threshold_grid(t, "confidence", "ok", [0.0, 0.1, 0.2, 0.3, 0.4, 0.5])


def evl13_precision_threshold(spark, sf_dir):
    t = _turns(spark, sf_dir).select(F.round(F.col("seconds") / 10).alias("confidence"), (F.col("status") != "error").alias("ok"))
    return threshold_for(t, "confidence", "ok", 0.81)


def evl14_softmax_nll(spark, sf_dir):
    """Mean log loss of three logits under a grid of temperatures."""
    t = _turns(spark, sf_dir).select((F.col("seconds") / 100).alias("a"), (F.coalesce("model_seconds", F.lit(0.0)) / 30).alias("b"), F.lit(0.5).alias("c"), (F.col("model_calls") - 1).alias("gold"))
    each = t.select("*", F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("temperature"))
    total = F.log(sum(F.exp(F.col(x) / F.col("temperature")) for x in "abc"))
    own = F.when(F.col("gold") == 0, F.col("a")).when(F.col("gold") == 1, F.col("b")).otherwise(F.col("c")) / F.col("temperature")
    return each.groupBy("temperature").agg(F.round(F.avg(total - own), 8).alias("nll"))


def evl15_brier(spark, sf_dir):
    p = F.least(F.col("seconds") / 200, F.lit(1.0))
    return _turns(spark, sf_dir).groupBy("model_calls").agg(F.round(F.avg((p - (F.col("status") == "view").cast("double")) ** 2), 8).alias("brier"), F.round(F.avg((p >= 0.5).cast("double")), 8).alias("coverage"))


def evl18_family_split(spark, sf_dir):
    return family_split(_turns(spark, sf_dir), "session_id")


def evl19_stratified_split(spark, sf_dir):
    return family_split(view(spark, sf_dir, "records"), "evidence_id", strata=["kind"]).groupBy("kind", "split").agg(F.count("*").alias("n"))


def evl21_source_health(spark, sf_dir):
    return view(spark, sf_dir, "supplier").agg(F.count_if(F.col("s_acctbal") < 0).alias("overdue"), F.count_if(F.col("s_nationkey") == 0).alias("unassigned"), F.count("*").alias("n"))


def evl22_route_assessment(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("accepted", F.col("seconds") >= 40)
    return t.groupBy("status").agg(F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & (F.col("model_calls") == 1)).alias("correct"), F.countDistinct(F.when(F.col("accepted"), F.col("session_id"))).alias("families"))


def evl24_pass_at_k(spark, sf_dir):
    w = W.partitionBy("session_id", "status").orderBy("ts", "turn_id")
    t = _turns(spark, sf_dir).withColumns({"ok": F.col("seconds") < 80, "trial": F.row_number().over(w)}).where("trial <= 3")
    each = t.groupBy("session_id", "status").agg(F.max(F.when(F.col("trial") == 1, F.col("ok"))).alias("first"), F.bool_and("ok").alias("every"))
    return each.groupBy("status").agg(F.count("*").alias("n"), F.count_if("first").alias("pass1"), F.count_if("every").alias("pass_every"))


def evl26_upper_median(spark, sf_dir):
    return quantiles(_turns(spark, sf_dir), ["session_id"], "seconds", {"median": 0.5}, "upper").select("session_id", "median")


def evl29_two_runs(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("run", F.when(F.col("session_id") < 50, "baseline").otherwise("candidate"))
    p = quantiles(t, ["run"], "seconds", {"p50": 0.5, "p95": 0.95, "p100": 1.0}).drop("n")
    return t.groupBy("run").agg(F.count_if(F.col("model_calls") == 3).alias("three_calls")).join(p, "run").select("run", *(F.round(n, 6).alias(n) for n in ("p50", "p95", "p100")), "three_calls")


def dst01_components(spark, sf_dir):
    """Families that share a normalized message are merged: smallest family of each connected part, over all conversations."""
    t = view(spark, sf_dir, "messages").select(F.col("conv_id").alias("family"), F.sha2(normalized_message(F.col("text")), 256).alias("message")).distinct()
    return merge_families(t, "family", "message")


def merge_families(pairs: DataFrame, family: str, message: str) -> DataFrame:
    """family and merged: smallest label spread over shared messages until nothing changes; a null message joins nothing.

    Each round is written by checkpoint(), so that lineage stays short and lost executors don't matter.
    """
    shared_dir(pairs.sparkSession)
    pairs = pairs.checkpoint()
    labels = pairs.select(family, F.col(family).alias("merged")).distinct()
    while True:
        low = pairs.join(labels, family).groupBy(message).agg(F.min("merged").alias("low"))
        near = pairs.join(low, message).groupBy(family).agg(F.min("low").alias("low"))
        step = labels.join(near, family, "left").select(family, F.col("merged").alias("old"), F.least("merged", "low").alias("merged"))
        jump = step.select(F.col(family).alias("merged"), F.col("merged").alias("far"))
        after = step.join(jump, "merged").select(family, "old", F.least("merged", "far").alias("merged")).checkpoint()
        labels = after.select(family, "merged")
        if after.where("merged <> old").isEmpty():
            return labels


def dst02_label_conflicts(spark, sf_dir):
    r = view(spark, sf_dir, "records")
    return r.groupBy("evidence_id").agg(F.countDistinct("kind").alias("kinds"), F.count("*").alias("n")).where("kinds > 1")


def dst04_split_checks(spark, sf_dir):
    split = family_split(_turns(spark, sf_dir), "session_id")
    t = _turns(spark, sf_dir).join(split, "session_id")
    return t.agg(F.countDistinct("split").alias("splits"), (F.count("*") - F.countDistinct("turn_id")).alias("repeated_ids"), (F.countDistinct("session_id", "split") - F.countDistinct("session_id")).alias("straddling"))


def dst08_alternate(spark, sf_dir):
    fam = _turns(spark, sf_dir).select("status", "session_id").distinct()
    return numbered(fam, ["status"], "session_id").groupBy("status", (F.col("_rank") % 2 == 1).alias("fit")).agg(F.count("*").alias("n"))


def mth01_cost(spark, sf_dir):
    t = _turns(spark, sf_dir)
    speed_up = 1 / ((1 - 0.6) + 0.6 / F.col("model_calls"))
    return t.select("turn_id", F.round(F.try_divide(F.col("model_calls") * 120, F.col("seconds")), 4).alias("tokens_per_second"), F.round(speed_up, 6).alias("amdahl"), F.round(1 - F.pow(F.lit(0.95), F.col("model_calls")), 8).alias("tail"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("agg", "win", "evl", "dst", "mth") and n[3:5].isdigit() and callable(f)}

_P = "quantile_cont({0}, {1})"


def _t(body: str, *more: str) -> str:
    return oracle(body, "turns", *more)


_SPLIT = "select session_id, case when r <= t then 'train' when r <= t + c then 'calibration' else 'test' end as split from (select session_id, r, round_even(0.6 * n, 0) as t, round_even(0.15 * n, 0) as c from (select session_id, row_number() over (order by sha1('7|' || session_id), session_id) as r, count(*) over () as n from (select distinct session_id from turns)))"
_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183)

SQL = {
    "agg14_median": _t("select status, round(median(seconds), 6) as median from turns group by all"),
    "agg15_percentiles": _t("select status, round(quantile_cont(seconds, 0.5), 6) as p50, round(quantile_cont(seconds, 0.95), 6) as p95, round(quantile_cont(seconds, 0.99), 6) as p99 from turns group by all"),
    "agg16_nearest_rank": _t("select status, v[cast(ceil(0.95 * len(v)) as int)] as p95 from (select status, list_sort(list(seconds)) as v from turns group by all)"),
    "agg17_floor_index": _t("select session_id, v[cast(floor(0.95 * (len(v) - 1)) as int) + 1] as p95 from (select session_id, list_sort(list(seconds)) as v from turns group by all)"),
    "agg18_wall_summary": _t("select model_calls, count(*) as n, round(median(seconds), 3) as median, round(quantile_cont(seconds, 0.95), 3) as p95, round(min(seconds), 3) as least, round(max(seconds), 3) as most from turns group by all"),
    "agg19_stage_medians": _t("select stage, round(median(s), 6) as median, count(*) as n from (select 'total' as stage, seconds as s from turns union all select 'model', model_seconds from turns where model_seconds is not null) group by all"),
    "agg20_hit_rate": _t("select session_id, h as hits, m as misses, round(coalesce(h / nullif(h + m, 0), 0), 4) as rate from (select session_id, count(*) filter (where status = 'view') as h, count(*) filter (where status = 'click') as m from turns group by all)"),
    "agg02_stage_summary": _t("select status, model_calls, count(*) as n, round(sum(seconds), 1) as seconds from turns group by all"),
    "agg26_call_counts": _t("select model_calls, count(*) as n, round(median(seconds - coalesce(model_seconds, 0)), 6) as other from turns group by all"),
    "agg05_pass_by_group": _t("select status, model_calls, count(*) filter (where seconds < 50) as passed, count(*) as total from turns group by grouping sets ((status), (model_calls), ())"),
    "agg06_rank_summary": _t("select status, count(*) as n, count(*) filter (where rank = 1) as pass1, count(*) filter (where rank <= 3) as pass3, round(avg(1.0 / rank), 4) as mrr, count(rank) as n_rr from (select *, case when seconds < 60 then turn_id % 7 + 1 end as rank from turns) group by status"),
    "win13_eviction": _t("select session_id, count(*) as kept, cast(max(bytes) as bigint) as bytes from (select session_id, count(*) over w as n, sum(cast(trunc(seconds) as bigint)) over w as bytes from turns window w as (partition by session_id order by model_calls desc, turn_id desc rows unbounded preceding)) where n <= 30 and bytes <= 1200 group by all"),
    "win16_energy": _t("select session_id, round(sum((seconds + s2) / 2 * (epoch_us(t2) - epoch_us(ts)) / 1e6) / 3600, 4) as wh from (select *, lead(seconds) over w as s2, lead(ts) over w as t2 from turns window w as (partition by session_id order by ts, seconds)) group by all"),
    "win17_counter": _t("select session_id, cast(sum(case when d < 0 then d + 1000 else d end) as bigint) as delta from (select session_id, turn_id * 37 % 1000 - lag(turn_id * 37 % 1000) over (partition by session_id order by ts, turn_id) as d from turns) group by all"),
    "win12_newest": _t("select session_id, rn, turn_id from (select *, row_number() over (partition by session_id order by ts desc, turn_id desc) as rn from turns) where rn <= 2"),
    "win15_mode_order": _t("select case when (turn_id + session_id + model_calls) % 2 = 0 then 'baseline first' else 'candidate first' end as mode, count(*) as n from turns group by all"),
    "evl03_engine_diff": _t("select session_id, case when a and not b then 'regressed' when not a and b then 'gained' else 'same' end as change from (select session_id, avg(seconds) < 55 as a from turns where model_calls = 1 group by all) full join (select session_id, avg(seconds) < 55 as b from turns where model_calls = 2 group by all) using (session_id)"),
    "evl04_status_quality": _t("select expected, count(*) filter (where status = expected) as correct, count(*) filter (where expected = 'click' and status = 'view') as false_hits, count(*) as n from (select *, case when session_id % 2 = 0 then 'view' else 'click' end as expected from turns) group by all"),
    "evl05_mcnemar": _t("select session_id, b, c, round(case when b + c = 0 then 1 else least(1, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) + (b + c) * ln(0.5))))) end, 8) as p from (select session_id, count(*) filter (where seconds < 50 and model_seconds >= 10) as b, count(*) filter (where seconds >= 50 and model_seconds < 25) as c from turns group by all)"),
    "evl06_wilson": _t(f"select session_id, k, n, round(greatest((p + {Z95 * Z95} / (2 * n)) / (1 + {Z95 * Z95} / n) - h, 0), 8) as low, round(least((p + {Z95 * Z95} / (2 * n)) / (1 + {Z95 * Z95} / n) + h, 1), 8) as high from (select *, {Z95} * sqrt(p * (1 - p) / n + {Z95 * Z95} / (4 * n * n)) / (1 + {Z95 * Z95} / n) as h from (select session_id, count(*) filter (where status = 'view') as k, count(*) as n, count(*) filter (where status = 'view') / count(*) as p from turns group by all))"),
    "evl07_rule_of_three": _t("select status, round(-ln(0.05) / count(*), 10) as upper, cast(ceil(-ln(0.05) / 0.01) as bigint) as needed from turns group by all"),
    "evl09_gates": _t("select status, case when s and v then 'SHIP' when s or v then 'HOLD' else 'REJECT' end as verdict from (select status, quantile_cont(seconds, 0.95) <= 160 as s, count(*) >= 300 as v from turns group by all)"),
    "evl12_threshold_grid": _t("select cast(t as double) as threshold, count(*) as accepted, count(*) filter (where status = 'view') as right, count(*) filter (where status <> 'view') as wrong from turns, (values (0.0), (0.1), (0.2), (0.3), (0.4), (0.5)) as g(t) where cast(t as double) <= seconds / 500 group by all"),
    "evl13_precision_threshold": _t("select confidence, cast(a as bigint) as accepted, round(a / total, 6) as coverage, round(r / a, 6) as precision from (select confidence, sum(n) over w as a, sum(k) over w as r, sum(n) over () as total from (select round(seconds / 10) as confidence, count(*) as n, count(*) filter (where status <> 'error') as k from turns group by all) window w as (order by confidence desc rows unbounded preceding)) where r >= 0.81 * a order by confidence limit 1"),
    "evl14_softmax_nll": _t("select cast(t as double) as temperature, round(avg(ln(exp(a / t) + exp(b / t) + exp(c / t)) - (case g when 0 then a when 1 then b else c end) / t), 8) as nll from (select seconds / 100 as a, coalesce(model_seconds, 0) / 30 as b, 0.5::double as c, model_calls - 1 as g from turns), (values (0.5::double), (1.0::double), (2.0::double)) as x(t) group by all"),
    "evl15_brier": _t("select model_calls, round(avg((least(seconds / 200, 1) - case when status = 'view' then 1 else 0 end) ** 2), 8) as brier, round(avg(case when least(seconds / 200, 1) >= 0.5 then 1.0 else 0.0 end), 8) as coverage from turns group by all"),
    "evl18_family_split": _t(_SPLIT),
    "evl19_stratified_split": oracle("select kind, split, count(*) as n from (select kind, case when r <= round_even(0.6 * n, 0) then 'train' when r <= round_even(0.6 * n, 0) + round_even(0.15 * n, 0) then 'calibration' else 'test' end as split from (select kind, row_number() over (partition by kind order by sha1('7|' || evidence_id), evidence_id) as r, count(*) over (partition by kind) as n from (select distinct kind, evidence_id from records))) group by all", "records"),
    "evl21_source_health": "select count(*) filter (where s_acctbal < 0) as overdue, count(*) filter (where s_nationkey = 0) as unassigned, count(*) as n from supplier",
    "evl22_route_assessment": _t("select status, count(*) filter (where seconds >= 40) as accepted, count(*) filter (where seconds >= 40 and model_calls = 1) as correct, count(distinct case when seconds >= 40 then session_id end) as families from turns group by all"),
    "evl24_pass_at_k": _t("select status, count(*) as n, count(*) filter (where f) as pass1, count(*) filter (where e) as pass_every from (select session_id, status, bool_or(trial = 1 and ok) as f, bool_and(ok) as e from (select session_id, status, seconds < 80 as ok, row_number() over (partition by session_id, status order by ts, turn_id) as trial from turns) where trial <= 3 group by all) group by all"),
    "evl26_upper_median": _t("select session_id, v[len(v) // 2 + 1] as median from (select session_id, list_sort(list(seconds)) as v from turns group by all)"),
    "evl29_two_runs": _t("select case when session_id < 50 then 'baseline' else 'candidate' end as run, round(quantile_cont(seconds, 0.5), 6) as p50, round(quantile_cont(seconds, 0.95), 6) as p95, round(max(seconds), 6) as p100, count(*) filter (where model_calls = 3) as three_calls from turns group by all"),
    "dst02_label_conflicts": oracle("select evidence_id, count(distinct kind) as kinds, count(*) as n from records group by all having count(distinct kind) > 1", "records"),
    "dst04_split_checks": _t(f"select count(distinct split) as splits, count(*) - count(distinct turn_id) as repeated_ids, cast(0 as bigint) as straddling from turns join ({_SPLIT}) using (session_id)"),
    "dst08_alternate": _t("select status, k % 2 = 1 as fit, count(*) as n from (select status, dense_rank() over (partition by status order by session_id) as k from (select distinct status, session_id from turns)) group by all"),
    "mth01_cost": _t("select turn_id, round(model_calls * 120 / nullif(seconds, 0), 4) as tokens_per_second, round(1 / (0.4 + 0.6 / model_calls), 6) as amdahl, round(1 - pow(0.95, model_calls), 8) as tail from turns"),
}
