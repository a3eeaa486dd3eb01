"""Operators on small inputs, against plain Python."""

import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwell.functions import text
from sparkwell.operators import bootstrap, more, records, retrieval, sequences, statistics
from sparkwell.sources import corpus
from sparkwell.streaming import sessions


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcd ", max_size=30), st.text("abcd ", max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs_ratio(a, b):
    want = 100.0 if not a and not b else 200.0 * plain_lcs(a, b) / (len(a) + len(b))
    assert sequences.lcs_ratio(a, b) == pytest.approx(want)


def test_unknown_lookup_key(spark):
    with pytest.raises(ValueError, match="not a lookup key"):
        records.exact_lookup(spark.range(1), colour="red")


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([50, 60, 30, 20, 5])], "k long, o long, n long")
    kept = sequences.within_budget(rows, "k", "o", "n", 100)
    assert sorted(r.o for r in kept.collect()) == [0, 2, 3]


def test_packing_repeats_last_paragraph(spark):
    paras = [" ".join(f"w{k}" for _ in range(100)) for k in range(7)]
    docs = spark.createDataFrame([(1, "\n".join(paras)), (2, "short"), (3, None)], "doc_id long, text string")
    units = {(r.doc_id, r.unit): r.text.split("\n") for r in sequences.pack_paragraphs(docs).collect()}
    first = [units[1, k] for k in range(len(units) - 2)]
    assert all(b[0] == a[-1] for a, b in zip(first, first[1:], strict=False))
    assert [p for k, u in enumerate(first) for p in u[k > 0:]] == paras
    assert units[2, 0] == ["short"] and units[3, 0] == [""]


def test_prefix_commit_never_shrinks(spark):
    rows = [(1, 0, "a b c"), (1, 1, "a b d"), (1, 2, "a b d e"), (1, 3, "a x"), (1, 4, "a b d e f")]
    got = {r.seq: (r.committed, r.pending) for r in sessions.committed(spark.createDataFrame(rows, "session_id long, seq long, hypothesis string")).collect()}
    assert got == {0: (0, 3), 1: (2, 1), 2: (3, 1), 3: (2, 0), 4: (3, 2)}


def test_ttl_hit_does_not_extend(spark):
    rows = [(k, "x", f"2024-01-01 00:00:{s:02d}") for k, s in enumerate([0, 5, 11, 12, 30])]
    t = spark.createDataFrame(rows, "turn_id long, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.turn_id: r.hit for r in sessions.ttl_cache(t, 10).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_heading_path_resets(spark):
    rows = [(1, 0, "H1"), (1, 1, "sub one"), (1, 2, "text text text"), (1, 3, "H2"), (1, 4, "text text text")]
    df = spark.createDataFrame(rows, "doc long, pos long, line string")
    got = sequences.heading_path(df, "doc", "pos", F.length("line") == 2, F.length("line") == 7, "line").orderBy("pos").collect()
    assert [(r.h1, r.h2) for r in got] == [("H1", None), ("H1", "sub one"), ("H1", "sub one"), ("H2", None), ("H2", None)]


def test_mcnemar_exact(spark):
    pairs = [(0, 0), (1, 5), (10, 2), (12, 12)]
    df = spark.createDataFrame(pairs, "b long, c long").withColumn("p", statistics.mcnemar_exact(F.col("b"), F.col("c")))
    for r in df.collect():
        n, k = r.b + r.c, min(r.b, r.c)
        want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert r.p == pytest.approx(want, abs=1e-9)


def test_mcnemar_of_large_sessions(spark, tmp_path):
    counts = {1: (5, 2), 2: (11, 15), 3: (20, 21), 4: (400, 330), 5: (0, 60), 6: (25000, 25200), 7: (3, 90), 8: (7, 3), 9: (3, 7)}
    rows = [(s, v) for s, (b, c) in counts.items() for v, n in ((40.0, b), (60.0, c)) for _ in range(n)]
    spark.createDataFrame(rows, "user_id long, value double").selectExpr("monotonically_increasing_id() as event_id", "user_id", "timestamp '2024-01-01' as ts", "'view' as event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.session_id: r for r in statistics.evl05_mcnemar(spark, str(tmp_path)).collect()}
    assert {s: (r.b, r.c) for s, r in got.items()} == counts
    for s, (b, c) in counts.items():
        n, k = b + c, min(b, c)
        term = total = math.comb(n, k)
        for i in range(k, 0, -1):
            term = term * i // (n - i + 1)
            total += term
        want = min(Fraction(1), Fraction(2 * total, 2**n))
        assert got[s].p == pytest.approx(float(want), abs=1e-8)


def test_merge_families(spark):
    r = random.Random(3)
    pairs = list({(r.randrange(40), r.randrange(35)) for _ in range(50)})
    got = {x.family: x.merged for x in statistics.merge_families(spark.createDataFrame(pairs, "family long, message long"), "family", "message").collect()}
    label = {f: f for f, _ in pairs}
    while True:
        before = dict(label)
        for m in {m for _, m in pairs}:
            low = min(label[f] for f, x in pairs if x == m)
            for f, x in pairs:
                if x == m:
                    label[f] = min(label[f], low)
        if label == before:
            break
    assert got == label


def test_components_of_all_conversations(spark, tmp_path):
    r = random.Random(5)
    said = [(f, f"message {r.randrange(50)}") for f in range(1, 41) for _ in range(r.randrange(1, 4))] + [(50, None), (51, None), (52, "  MESSAGE   7?! ")]
    rows = [(f, k, "user", r.choice([m, m.upper(), f" {m}  ?"]) if m else m) for k, (f, m) in enumerate(said)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    top = {f: f for f, _ in said}

    def root(f):
        while top[f] != f:
            f = top[f]
        return f

    first = {}
    for f, m in said:
        if m is not None:
            a, b = root(f), root(first.setdefault(m.strip().lower().rstrip("?! ").replace("   ", " "), f))
            top[max(a, b)] = min(a, b)
    want = {f: root(f) for f in top}
    assert 1 < len(set(want.values())) < len(want)
    assert {x.family: x.merged for x in statistics.dst01_components(spark, str(tmp_path)).collect()} == want


def test_document_frequency_of_all_terms(spark, tmp_path):
    rows = [(k, lang, " ".join(f"w{j}" for j in range(k, k + 3)) + " w0") for k in range(30) for lang in ("en", "de")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter((lang, t) for _, lang, text in rows for t in set(text.split()))
    assert {(r.lang, r.term): r.df for r in retrieval.agg27_document_frequency(spark, str(tmp_path)).collect()} == want


def test_terms_of_three_letters_match(spark, tmp_path):
    r, terms = random.Random(2), ["ab", "cat", "tree", "house", "garden", "windows", "the", "und"]
    said = lambda k: [(j, " ".join(r.choices(terms, k=4))) for j in range(k)]
    docs, items = said(25), said(4)
    spark.createDataFrame([(k, "en", t, "s", len(t)) for k, t in docs], "doc_id long, lang string, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = set()
    for item, text in items:
        own = {t for t in text.split() if len(t) > 2 and t != "the"}
        order = sorted((-n, doc) for doc, other in docs if (n := len(own & set(other.split()))))
        want |= {(item, doc, -n, k) for k, (n, doc) in enumerate(order[:6], 1)}
    assert {(x.item_id, x.doc_id, x.overlap, x.rank) for x in more.txt32_term_match(spark, str(tmp_path)).collect()} == want


def test_dedup_key_of_whole_texts(spark, tmp_path):
    head = "the same long beginning " * 5
    rows = [(1, head + "one", "en"), (2, head + "two", "en"), (3, head.upper() + " One!", "en"), (4, head + "one", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r["n"], r["first"]) for r in text.txt21_dedup_key(spark, str(tmp_path)).collect()) == [(1, 2), (1, 4), (2, 1)]


def test_token_windows_cover_all(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(250)))), (2, "a b")], "doc_id long, text string")
    got = {}
    for r in retrieval.token_windows(df, 100, 20).collect():
        got.setdefault(r.doc_id, {})[r.chunk] = r.text.split()
    assert got[2] == {0: ["a", "b"]}
    assert [x for k in sorted(got[1]) for x in got[1][k][20 * (k > 0):]] == [str(i) for i in range(250)]


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_text("<!DOCTYPE html><p>x")
    (tmp_path / "sub" / "b.json").write_text('{"a": 1}')
    (tmp_path / ".hidden").write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.format for r in corpus.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.html": "html", "b.json": "json"}


def test_sessions_on_a_stream_match_the_table(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00") for u in (1, 2) for h, m in ((0, 0), (0, 20), (3, 0), (9, 0), (9, 50))] + [(9, "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "e.parquet"))
    streamed = sessions.replay(spark, str(tmp_path / "e.parquet"), lambda e: sessions.sessions(e, "user_id", "1 hour", late="1 day"), time="ts")
    want = sorted((r.user_id, r.n) for r in sessions.sessions(df, "user_id", "1 hour").collect())
    assert sorted((r.user_id, r.n) for r in streamed.collect()) == want


def test_update_mode_gives_last_versions(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("2024-01-01 00:00:00", "a", float(k))], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"part{k}.parquet"))
    got = sessions.replay(spark, f"{tmp_path}/part?.parquet", lambda e: sessions.tumbling(e, "1 day"), "update", key=["window", "event_type"]).collect()
    assert [(r.n, r.value) for r in got] == [(3, 3.0)]


def test_dense_blocks_match_plain_products(spark):
    import numpy as np

    r = np.random.default_rng(2)
    vectors = r.normal(size=(300, 7)).round(1)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(999, None)], "doc_id long, v array<double>").repartition(5)
    queries = df.where("doc_id % 50 = 0").select(F.col("doc_id").alias("item_id"), F.col("v").alias("q"))
    score = (vectors[::50] @ vectors.T).round(9)
    every = {(x.item_id, x.doc_id): x.score for x in retrieval.dense(queries, df, size=16).collect()}
    assert len(every) == 6 * 300 and all(every[50 * i, j] == pytest.approx(score[i, j]) for i in range(6) for j in range(300))
    best = retrieval.top(retrieval.dense(queries, df, 10, size=16), 10).collect()
    assert {(x.item_id, x.doc_id) for x in best} == {(50 * i, int(j)) for i in range(6) for j in sorted(range(300), key=lambda j: (-score[i, j], j))[:10]}


def test_cardinals_count_up(spark):
    want = {0: "zero", 21: "twenty one", 100: "one hundred", 1999: "one thousand nine hundred ninety nine", 250000: "two lakh fifty thousand", 12345678: "one crore twenty three lakh forty five thousand six hundred seventy eight", -7: "minus seven", 1500000003000: "one lakh fifty thousand crore three thousand", None: None}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.w for r in df.select("n", more.in_words(F.col("n")).alias("w")).collect()} == want
    assert spark.range(20000).select(more.in_words(F.col("id")).alias("w")).distinct().count() == 20000


def test_expressions_on_single_texts(spark):
    one = lambda c, **cols: spark.createDataFrame([tuple(cols.values())], list(cols)).select(c.alias("x")).first().x if cols else spark.range(1).select(c.alias("x")).first().x
    q = F.col("q")
    for t, share, lang in (("नमस्ते दुनिया", 1.0, "hi"), ("hello world", 0.0, "en"), ("123", 0.0, "en"), ("abc अ abc abc", 0.1, "en"), ("hello दुनिया yes", 6 / 14, "mixed")):
        assert one(text.script_share(q), q=t) == pytest.approx(share) and one(text.language_of(q), q=t) == lang
    assert [one(text.language_hint(q), q=t) for t in ("fees kya hai", "what is the fee", "शुल्क", "hai")] == ["hinglish", None, "hindi", None]
    assert [one(text.citation_tags(q), q=t) for t in ("see [S2] and [S1] and [S2]", "none", "[S10]")] == [["2", "1"], ["1", "2"], ["10"]]
    assert one(text.strip_accents(q), q="Ünïcode ﬁ café") == "Unicode fi cafe"
    found = {t: {n: one(c, q=t) for n, c in more.rank_filters(q).items()} for t in ("Closing rank 2019 round 3 programme-7", "rank in 2018 or 2019", "round 2 cutoff for women", "hello")}
    assert [(f["year"], f["round"], f["programme"], f["gender"], f["basis"]) for f in found.values()] == [("2019", "3", "programme-7", None, "closing"), (None,) * 5, (None, "2", None, "women", None), (None,) * 5]
    assert [one(more.follow_up(F.col("b"), F.col("n")), b=b, n=n) for b, n in (("fee for category-1", "and category-2?"), ("fee for category-1", "hello"), ("round 2 fee", "round 3"), ("round 2 fee", "category-4"))] == ["fee for category-2", "hello", "round 3 fee", "category-4"]
    years = lambda s, p: one(text.years_of(F.lit(s).cast("array<string>") if s is None else F.array(*map(F.lit, s)), F.lit(p)))
    assert years(None, "a/2021_x/12020/2020-2021.pdf") == ["2020", "2021"] and years(["2019"], "2020") == ["2019"]


def test_rows_of_tables_in_text(spark):
    df = spark.createDataFrame([("| Exam | 12 May 2024 |",), ("Exam | May",), ("a | b | c | d | 3 June",), ("Fest | x | 1 July",)], "line string")
    assert sorted((r.event, r.date) for r in text.calendar_rows(df, "line").collect()) == [("Exam", "12 May 2024"), ("Fest", "1 July")]
    df = spark.createDataFrame([("| [A B](u/1) | Prof | CS | a.b [at] x [dot] org | 12 |",), ("| A | B | C | D |",), ("a|b|c|d|e",)], "line string")
    assert sorted(((r.name, r.role, r.email) for r in text.people_rows(df, "line").collect()), key=str) == [("A B", "Prof", "a.b@x.org"), ("a", "b", None)]


@pytest.mark.parametrize("kind", ["linear", "nearest", "floor", "upper"])
def test_quantiles_of_groups(spark, kind):
    import numpy as np

    r = random.Random(4)
    rows = [(k, float(r.choice((r.randrange(5), r.random())))) for k, n in ((1, 900), (2, 1), (3, 2), (4, 37)) for _ in range(n)] + [(1, None), (5, None)]
    wanted = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0, "e": 0.013}
    got = {x.k: x for x in statistics.quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", wanted, kind).collect()}
    assert set(got) == {1, 2, 3, 4}
    for k, row in got.items():
        v = sorted(x for j, x in rows if j == k and x is not None)
        n = len(v)
        at = {"nearest": lambda q: v[max(1, math.ceil(q * n)) - 1], "floor": lambda q: v[math.floor(q * (n - 1))], "upper": lambda q: v[min(math.floor(q * n), n - 1)], "linear": lambda q: float(np.quantile(v, q))}[kind]
        assert row.n == n and all(row[name] == pytest.approx(at(q)) for name, q in wanted.items())


def test_numbers_and_thresholds_over_ranges(spark):
    r = random.Random(9)
    values = r.sample(range(10**6), 500)
    got = statistics.numbered(spark.createDataFrame([(k % 3, v) for k, v in enumerate(values)], "k int, v long"), ["k"], "v").collect()
    for k in range(3):
        own = sorted(v for j, v in enumerate(values) if j % 3 == k)
        assert {x.v: x["_rank"] for x in got if x.k == k} == {v: i for i, v in enumerate(own, 1)} and {x["_n"] for x in got if x.k == k} == {len(own)}
    rows = [(r.randrange(200) / 200, r.random() < 0.7) for _ in range(3000)] + [(0.999, True)] * 5
    want = None
    for c in sorted({c for c, _ in rows}):
        over = [ok for x, ok in rows if x >= c]
        if want is None and sum(over) >= 0.74 * len(over):
            want = (c, len(over))
    found = statistics.threshold_for(spark.createDataFrame(rows, "c double, ok boolean"), "c", "ok", 0.74).first()
    assert (found.c, found.accepted) == want


def test_paired_bootstrap_covers_a_known_difference(spark):
    r = random.Random(1)
    rows = [(k, (a := r.random() * 10), a + 1 + r.random()) for k in range(2000)]
    got = bootstrap.paired_bootstrap(spark.createDataFrame(rows, "k long, a double, b double"), "k", "a", "b", 80).first()
    assert got.rounds == 80 and 1.45 < got.mean_low < 1.5 < got.mean_high < 1.55 and got.ratio_low < got.ratio_high < 1.25


def test_assembly_places_each_document_once(spark):
    df = lambda *rows: spark.createDataFrame([("q", *r) for r in rows], "item_id string, doc_id long, rank long")
    got = more.assemble(df((1, 1)), df((1, 1), (2, 2), (3, 3)), df((3, 1), (4, 2), (5, 3), (6, 4)), 3)
    assert sorted((r.position, r.doc_id, r.section) for r in got.collect()) == [(1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 5, 2)]


def test_fuzzy_cells_match_brute_force(spark):
    r = random.Random(6)
    base = ["fees of the first year", "hostel rent", "mess", "a", "library deposit", "aaaa aaaa aaaa", "caution money deposit"]

    def bent(w):
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w = w[:k] + r.choice("xyz") + w[k:] if r.random() < 0.5 or len(w) < 2 else w[:k] + w[k + 1:]
        return w

    cells = [(k, bent(r.choice(base)), bent(r.choice(base))) for k in range(150)]
    wanted = [(k, bent(r.choice(base)), bent(r.choice(base))) for k in range(150)]
    ratio = lambda a, b: 200.0 * plain_lcs(a, b) / (len(a) + len(b))
    want = {}
    for i, a, b in wanted:
        same = [k for k, x, y in cells if (x, y) == (a, b)]
        like = [k for k, x, y in cells if ratio(a, x) >= 90 and ratio(b, y) >= 90]
        if same or like:
            want[i] = (min(same or like), bool(same))
    got = sequences.fuzzy_cells(spark.createDataFrame(wanted, "id long, row_key string, col_key string"), spark.createDataFrame(cells, "cell_id long, row_key string, col_key string"))
    assert {x.id: (x.cell_id, x.exact) for x in got.collect()} == want
    assert {e for _, e in want.values()} == {True, False}
