"""Toxicity, pieces, packing and the pipeline."""

import zlib

import numpy as np
import pytest
from compare import SMALL

import corpus_pipeline
from sparkwell.llm import bpe, near_dedup, packing, pieces, pii, registry, toxicity


def test_gradients():
    net = toxicity.Network.fresh()
    for k in ("wx", "wh", "att", "out", "bn", "bx"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    words, ids, mask, _ = toxicity._windows([toxicity.words_of("a bad idiot here"), toxicity.words_of("fine word")])
    table, ids = toxicity._local(net, words, ids)
    table, y = table.astype(np.float64), np.array([1, 0], np.float32)
    g = net.gradients(table, ids, mask, y)

    def loss():
        p = 1 / (1 + np.exp(-net.forward(table, ids, mask)[0]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, at in (("wh", (0, 1, 2)), ("wh", (1, 3, 20)), ("att", (12,)), ("out", (5,)), ("bn", (1, 2)), ("table", (2, 0, 5))):
        x = table if name == "table" else getattr(net, name)
        old, e = x[at], 1e-2
        x[at] = old + e
        up = loss()
        x[at] = old - e
        down = loss()
        x[at] = old
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=2e-3, abs=1e-6)


def plain_score(net, text):
    """The network in plain Python loops: embeddings, both directions, attention and the worst window."""
    import math

    words = toxicity.words_of(text)
    sig = lambda x: 1 / (1 + math.exp(-x))
    hidden = toxicity.HIDDEN

    def given(word):
        w, g, _ = toxicity.features([word])
        return [float(net.words[w[0], i]) + sum(float(net.grams[k, i]) for k in g) / len(g) for i in range(toxicity.INPUT)]

    def states(xs, d):
        h, out = [0.0] * hidden, []
        for x in xs:
            gates = [sum(x[i] * float(net.wx[d, i, j]) for i in range(len(x))) + float(net.bx[d, j]) for j in range(3 * hidden)]
            own = [sum(h[i] * float(net.wh[d, i, j]) for i in range(hidden)) for j in range(3 * hidden)]
            z = [sig(gates[j] + own[j]) for j in range(hidden)]
            r = [sig(gates[hidden + j] + own[hidden + j]) for j in range(hidden)]
            c = [math.tanh(gates[2 * hidden + j] + r[j] * (own[2 * hidden + j] + float(net.bn[d, j]))) for j in range(hidden)]
            h = [c[j] + z[j] * (h[j] - c[j]) for j in range(hidden)]
            out.append(h)
        return out

    best = -math.inf
    for a in toxicity.starts(len(words)):
        xs = [given(w) for w in words[a:a + toxicity.WINDOW]]
        both = [x + y for x, y in zip(states(xs, 0), states(xs[::-1], 1)[::-1], strict=True)]
        s = [sum(x * float(w) for x, w in zip(v, net.att, strict=True)) for v in both]
        p = [math.exp(x - max(s)) for x in s] if s else []
        pooled = [sum(q * v[j] for q, v in zip(p, both, strict=True)) / sum(p) for j in range(2 * hidden)] if p else [0.0] * 2 * hidden
        best = max(best, sum(x * float(w) for x, w in zip(pooled, net.out, strict=True)) + float(net.bias[0]))
    return sig(best)


def test_scores_of_whole_texts_against_plain_loops():
    rows = toy(120, 4)
    net = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = ["", "word1", "nastyword word2", *(t for _, t, _ in rows[:6]), " ".join(f"word{k} nastything"[: 6 + k % 12] for k in range(170))]
    got = toxicity.Scorer(net).score(texts)
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=2e-4)


def test_sample_is_drawn_from_documents_that_are_there(spark):
    """Labels of many other documents don't thin the sample; a doc_id that is repeated or too long counts once or not."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(300)] + [(0, "a copy"), (7, "again"), (400, "x" * 9000)], "doc_id long, text string")
    labels = spark.range(50_000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    got = toxicity.training_sample(docs, labels, per_label=60).collect()
    assert sum(r.toxic == 0 for r in got) == sum(r.toxic == 1 for r in got) == 60
    every = toxicity.training_sample(docs, labels).count()
    assert every == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(300))


def toy(n, seed):
    r = np.random.default_rng(seed)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(n):
        w = [words[i] for i in r.integers(0, 300, r.integers(5, 200))]
        if bad := k % 3 == 0:
            for _ in range(3):
                w[r.integers(0, len(w))] = ("nastyword", "nastything", "nastier")[r.integers(0, 3)]
        rows.append((k, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark, odd, empty):
    rows = toy(600, 1)
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert isinstance(model, bytes)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert np.mean([(got[k] >= 0.7) == (y == 1) for k, y in held]) > 0.95
    assert toxicity.training_sample(docs, labels).count() <= len(rows) - len(held)
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    kept = toxicity.reject(odd, model)
    assert kept.columns == odd.columns and kept.count() <= odd.count() and toxicity.reject(empty, model).count() == 0


def test_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.fit(odd, labels)
        with pytest.warns(UserWarning, match="nothing is rejected"):
            toxicity.reject(odd, model)
        assert isinstance(model, float) and toxicity.score(odd, model).count() == odd.count() == toxicity.reject(odd, model).count()


def test_windows_cover_the_text_and_count_its_worst_part():
    for n in (0, 1, 47, 48, 49, 100, 1000):
        s = toxicity.starts(n)
        assert set(range(n)) == {i for a in s for i in range(a, min(n, a + toxicity.WINDOW))}
    rows = toy(450, 2)
    scorer = toxicity.Scorer(toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows]))
    clean = " ".join(["word1 word2 word3"] * 3000)
    alone, inside = scorer.score([clean, f"{clean} nastyword nastything nastier {clean}"])
    assert alone < 0.7 <= inside


def test_toxicity_query(spark):
    rows = registry.queries()["op1_toxicity"](spark, SMALL).collect()
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


def plain_viterbi(p, found, text):
    best = [(0.0, None)] + [(-float("inf"), None)] * len(text)
    for e in range(1, len(text) + 1):
        for n in range(min(e, 60), 0, -1):
            i = found.get(text[e - n:e])
            if i and best[e - n][0] + i[1] > best[e][0]:
                best[e] = best[e - n][0] + i[1], (n, i[0])
        if best[e - 1][0] + p.unknown > best[e][0]:
            best[e] = best[e - 1][0] + p.unknown, (1, None)
    out, n = [], len(text)
    while n:
        k, i = best[n][1]
        out += [i] if i is not None else [p.byte_ids[b] for b in reversed(text[n - 1].encode())]
        n -= k
    return out[::-1]


def test_pieces_best_and_round_trip(spark, odd, empty):
    p = pieces.pieces()
    found = {text: (i, s) for length, i, s in p.automaton.values() if (text := p.raw[i].decode().replace(" ", pieces.MARK))}
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).collect()]
    for t in texts:
        t = t[:300]
        assert np.frombuffer(p.encode(t), "<u4").tolist() == plain_viterbi(p, found, pieces.MARK + t.replace(" ", pieces.MARK))
    for t in ["", " ", "a", "  two  spaces ", "日本語 ▁ x▁", "▁", "x\x00y 😀", *texts]:
        assert p.decode(p.encode(t)) == t
    long = "".join(texts)[:6000].replace(" ", "")
    assert len(long) > pieces.LONG and list(p.best(long)) == plain_viterbi(p, found, long)
    small = pieces.Pieces({0: ("a", -1.0), 1: ("ab", -1.5), 2: ("b", -1.0), 3: ("▁a▁b", -0.1)}, list(range(4, 260)))
    assert not small.apart and np.frombuffer(small.encode("a b"), "<u4").tolist() == [3]
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(odd)).collect() if r.doc_id not in (None, 2)}
    assert back == {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id not in (None, 2)}
    assert all(r.round_trip for r in pieces.coded(odd).collect()) and pieces.coded(empty).count() == 0


def check_packing(rows, texts):
    encode = bpe.encoder().encode
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces_ in by_doc.items():
        ids, at = encode(texts[d] or "") + b"\x01\0\0\0", 0
        for r in sorted(pieces_, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) // 4 and r.ids_crc32 == zlib.crc32(ids[at * 4:(at + r.length) * 4])
            at += r.length
        assert at * 4 == len(ids)
    total = padding = 0
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
        total, padding = total + at, padding + (0 if at & (at - 1) == 0 else packing.CAPACITY - at)
    return padding / (total + padding)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert check_packing(packing.op8_packing(spark, SMALL).collect(), texts) < 0.01


def test_packing_odd_rows(spark, odd, empty):
    rows = packing.pack(odd.where("doc_id <> 2").unionByName(odd.where("doc_id is null").limit(1))).collect()
    assert sum(r.doc_id is None for r in rows) >= 1
    assert packing.pack(empty).count() == 0
    for n in (1, 2, 64, 65, 1000, 2047, 2048, 2049, 100_001):
        assert sum(packing.cuts(n)) == n and max(packing.cuts(n)) <= packing.CAPACITY


def test_pipeline_decisions_hold(spark, tmp_path):
    """Each stage on what the one before it kept, held against the operators' own results and brute force."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            net = toxicity.Network.load(model)
            scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
            assert {r.doc_id for r in after.collect()} == {d for d, s in scored.items() if s < toxicity.TOXIC_FROM}
            for r in docs.where("length(text) < 900").orderBy("doc_id").limit(5).collect():
                assert scored[r.doc_id] == pytest.approx(plain_score(net, r.text), abs=2e-4)
        if name == "exact dedup":
            texts = {"".join((r.text or "").split()) for r in docs.collect()}
            assert after.count() == len(texts)
        if name == "near dedup":
            from test_copies import plain_classes

            rows = docs.orderBy("doc_id").collect()
            assert {r.doc_id for r in after.collect()} == {rows[k].doc_id for k in plain_classes([r.text for r in rows])}
        if name == "pii":
            before = {r.doc_id: r.text for r in docs.collect()}
            for r in after.collect():
                assert r.text == pii.replaced(before[r.doc_id], pii.find(before[r.doc_id])) and r.n_chars == len(r.text)
        if name == "packing":
            assert check_packing(after.collect(), {r.doc_id: r.text for r in docs.collect()}) < 0.02
        else:
            assert after.columns == columns
        docs = after
    assert near_dedup.THRESHOLD == 0.8


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names pass every stage; no stage makes rows of none."""
    for at, docs in (("odd", odd), ("empty", empty)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SMALL).write.parquet(str(tmp_path / at / str(k)))
            after = spark.read.parquet(str(tmp_path / at / str(k)))
            assert k == len(corpus_pipeline.STAGES) - 1 or after.columns == columns and after.count() <= docs.count()
            docs = after
        assert (docs.count() > 0) == (at == "odd")
