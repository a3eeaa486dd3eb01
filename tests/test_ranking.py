"""Best documents by bounds, and joins of intervals, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sparkwell.operators import intervals, ranking


def plain_scores(questions, docs, once):
    bags = [Counter(t.split()) for _, t in docs]
    n, average = len(docs), max(1.0, sum(map(lambda b: sum(b.values()), bags)) / len(docs))
    df = Counter(w for b in bags for w in b)
    out = {}
    for i, q in questions:
        for (d, _), b in zip(docs, bags, strict=True):
            hit = {w: k for w, k in Counter((q or "").split()).items() if w in b}
            if hit:
                out[i, d] = sum((1 if once else k) * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.5 / (b[w] + 1.5 * (0.25 + 0.75 * sum(b.values()) / average)) for w, k in hit.items())
    return out


@pytest.mark.parametrize("once", [False, True])
@pytest.mark.parametrize("sent", [1_000_000, 5])
def test_best_documents_are_those_of_plain_scores(spark, monkeypatch, once, sent):
    monkeypatch.setattr(ranking, "SENT", sent)
    monkeypatch.setattr(ranking, "BLOCK", 16)
    r = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(["common"] * r.randrange(1, 4) + [vocabulary[int(r.random() ** 3 * 60)] for _ in range(r.randrange(0, 30))])) for k in range(200)]
    questions = [(k, " ".join(["common"] * r.randrange(0, 3) + [vocabulary[int(r.random() ** 2 * 60)] for _ in range(r.randrange(0, 6))])) for k in range(25)] + [(90, "nowhere"), (91, None)]
    got = {(x.item_id, x.doc_id): x.score for x in ranking.bm25_best(spark.createDataFrame(questions, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 7, not once).collect()}
    want = plain_scores(questions, docs, once)
    for i, _ in questions:
        mine = sorted((-s, d) for (q, d), s in want.items() if q == i)
        found = {d: s for (q, d), s in got.items() if q == i}
        assert {d for _, d in mine[:7]} <= {*found} and all(math.isclose(s, want[i, d]) for d, s in found.items())
        if len(mine) > 7:
            assert {d for s, d in mine if s == mine[6][0]} <= {*found}


def test_common_terms_bring_in_no_documents():
    """Once ten documents have a rare term, a term that all documents have isn't scored against the rest."""
    n = 3000
    doc = np.concatenate((np.arange(n), np.arange(10)))
    term = np.concatenate((np.zeros(n, np.int64), np.ones(10, np.int64)))
    weight = np.concatenate((np.full(n, 0.01), np.full(10, 5.0)))
    asked, best = [(np.array([0, 1]), np.ones(2))], {}
    assert ranking.score_block(asked, best, 10, np.arange(n), doc, term, weight) == n
    assert ranking.score_block(asked, best, 10, np.arange(n) + n, doc, term, weight) == 10
    assert sorted(best[0].docs.tolist()) == [*range(10), *range(n, n + 10)]


def test_no_questions_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert ranking.bm25_best(none, docs, 3).count() == 0
    assert ranking.bm25_best(spark.createDataFrame([(1, "xx yy")], "item_id long, text string"), docs.where("false"), 3).count() == 0


def some_intervals(r, n):
    out = []
    for k in range(n):
        a = r.randrange(-500, 500)
        out.append((k, r.randrange(2), a, a + r.choice((0, 0, 1, 2, 3, 4, 7, 8, 100, 5000, -1))))
    return [*out, (n, 0, None, 3), (n + 1, 0, 3, None), (n + 2, 1, -(1 << 45), 1 << 45)]


def test_intervals_that_cover_points(spark):
    r = random.Random(3)
    rows = some_intervals(r, 120)
    points = [(k, r.randrange(2), r.randrange(-600, 600)) for k in range(150)] + [(900, 0, None), (901, 1, 1 << 45)]
    frame = spark.createDataFrame(rows, "i long, g int, start long, stop long")
    met = intervals.covering(spark.createDataFrame(points, "p long, g int, at long"), frame, "at", "start", "stop", ["g"])
    want = sorted((p, i) for p, g, at in points for i, h, a, b in rows if g == h and None not in (at, a, b) and a <= at <= b)
    assert sorted((x.p, x.i) for x in met.collect()) == want
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "sequence(" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    small = frame.where("stop - start < 1000")
    assert sorted((x.p, x.i) for x in intervals.covering(spark.createDataFrame(points, "p long, g int, at long"), small, "at", "start", "stop", ["g"]).collect()) == [x for x in want if rows[x[1]][3] - rows[x[1]][2] < 1000]


def test_intervals_that_overlap(spark):
    r = random.Random(4)
    one, two = some_intervals(r, 80), some_intervals(r, 60)
    a, b = (spark.createDataFrame(x, f"{k} long, g int, start long, stop long") for x, k in ((one, "i"), (two, "j")))
    got = sorted((x.i, x.j) for x in intervals.overlapping(a, b, "i", "j", ["g"]).collect())
    ok = lambda x: None not in x and x[2] <= x[3]
    assert got == sorted((x[0], y[0]) for x in filter(ok, one) for y in filter(ok, two) if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
