"""Bootstrap rounds against plain Python, and intervals against plain resampling."""

import math
import random

import numpy as np
import pytest

from sparkwell.operators import bootstrap

M = (1 << 64) - 1


def plain_mix(z):
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
    z = (z ^ z >> 27) * 0x94D049BB133111EB & M
    return z ^ z >> 31


def plain_weight(key, r):
    seed = plain_mix((key % (1 << 64)) + 0x9E3779B97F4A7C15 & M)
    h = plain_mix(seed + (r // 4 + 1) * 0x9E3779B97F4A7C15 & M)
    u = h >> 16 * (r % 4) & 65535
    return sum(u >= round(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(8))


@pytest.mark.parametrize("sent", [2_000_000, 0])
@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_rounds_are_exact(spark, monkeypatch, sent, kind):
    monkeypatch.setattr(bootstrap, "SENT", sent)
    r = random.Random(2)
    rows = [(k * 37 - 5, *((5.0, 5.0) if kind == "one" else (float(r.randrange(4)), float(r.randrange(3))) if kind == "ties" else (r.random(), r.random()))) for k in range(90)]
    odd = [(1_000, None, 1.0), (1_001, 1.0, None), (1_002, float("nan"), 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "k long, a double, b double")
    got = {x["round"]: x for x in bootstrap.bootstrap_rounds(df, "k", "a", "b", 50, [("a", 0.5), ("b", 0.95), ("a", 0.0), ("b", 1.0)]).collect()}
    for j in range(50):
        drawn = [x for x in rows for _ in range(plain_weight(x[0], j))]
        a, b = (np.array([x[c] for x in drawn]) for c in (1, 2))
        assert got[j].n == len(drawn) and math.isclose(got[j]["mean"], (b - a).mean(), abs_tol=1e-12)
        assert np.allclose([got[j][f"q_{k}"] for k in range(4)], [np.quantile(a, 0.5), np.quantile(b, 0.95), a.min(), b.max()])


def test_bounds_are_widened_until_every_round_is_inside(spark, monkeypatch):
    tight = bootstrap._bounded
    seen = []
    monkeypatch.setattr(bootstrap, "_bounded", lambda pairs, wanted, n, widen: (seen.append(widen), tight(pairs, wanted, n, widen / 64)))
    r = random.Random(3)
    df = spark.createDataFrame([(k, r.random(), r.random()) for k in range(400)], "k long, a double, b double")
    wide = {x["round"]: x.q_0 for x in bootstrap.bootstrap_rounds(df, "k", "a", "b", 40, [("a", 0.5)]).collect()}
    monkeypatch.setattr(bootstrap, "_bounded", tight)
    assert len(seen) > 2 and wide == {x["round"]: x.q_0 for x in bootstrap.bootstrap_rounds(df, "k", "a", "b", 40, [("a", 0.5)]).collect()}


def test_intervals_are_those_of_plain_resampling(spark):
    r = np.random.default_rng(5)
    a = r.exponential(10, 400)
    b = a * r.uniform(0.6, 1.1, 400)
    got = bootstrap.paired_bootstrap(spark.createDataFrame([(f"case-{k}", float(x), float(y)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "k string, a double, b double"), "k", "a", "b").first()
    drawn = r.integers(0, 400, (10_000, 400))
    A, B = a[drawn], b[drawn]
    plain = {"mean": (B - A).mean(1), "median": np.quantile(B, 0.5, axis=1) - np.quantile(A, 0.5, axis=1), "ratio": np.quantile(B, 0.95, axis=1) / np.quantile(A, 0.95, axis=1)}
    assert got.rounds == 10_000
    for name, values in plain.items():
        for end, q in (("low", 0.025), ("high", 0.975)):
            assert abs(got[f"{name}_{end}"] - np.quantile(values, q)) < 0.12 * values.std() + 1e-6


def test_no_pairs(spark):
    empty = spark.createDataFrame([(1, None, 2.0)], "k long, a double, b double")
    assert bootstrap.bootstrap_rounds(empty, "k", "a", "b", 20, [("a", 0.5)]).count() == 0
    assert bootstrap.paired_bootstrap(empty, "k", "a", "b", 20).first().rounds == 0
