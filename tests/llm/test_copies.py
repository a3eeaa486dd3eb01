"""Exact and near copies and fingerprints, against brute force."""

import hashlib
import itertools
import math
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from sparkwell.llm import common, counters, exact_dedup, hashing, near_dedup, spotsigs
from sparkwell.llm.common import scratch

ROOT = Path(__file__).resolve().parents[2]


def test_exact_query_matches_sql(spark):
    assert rows_of_spark(exact_dedup.op3_exact_dedup(spark, SMALL)) == rows_of_duckdb(database(SMALL), exact_dedup.ORACLE_SQL)


def plain_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault("".join(c for c in text or "" if c not in exact_dedup.BLANKS), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    return Counter((hashlib.sha256(k.encode()).hexdigest(), None if min(g)[1] else min(g)[2], len(g)) for k, g in groups.items())


@pytest.mark.parametrize("weak", [False, True])
def test_exact_odd_rows_and_colliding_digests(spark, odd, weak):
    """With a digest of two values nearly all texts collide; full bytes still tell them apart."""
    digest = (lambda t: (F.length(t) % 2).cast("string")) if weak else exact_dedup.sha256_digest
    got = exact_dedup.dedup(odd, digest).collect()
    assert len(got) == odd.count()
    assert Counter((r.text_sha256, r.keep_id, r.group_size) for r in got if r.kept) == plain_exact([(r.doc_id, r.text) for r in odd.collect()])


def test_exact_empty_and_columns(spark, odd, empty):
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(plain_exact([(r.doc_id, r.text) for r in odd.collect()]))


def test_exact_state_goes_on(spark):
    """A second call with the same folder knows the first one's rows; a batch that is sent twice counts once."""
    at = scratch(spark, "state")
    first = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    more = spark.createDataFrame([(3, "ab  "), (4, "d")], "doc_id long, text string")
    exact_dedup.dedup(first, state_dir=at, batch="first")
    records = spark.read.parquet(f"{at}/records")
    assert records.count() == 2
    for _ in range(2):
        rows = exact_dedup.dedup(more, state_dir=at, batch="more").collect()
        assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(1, 3, 2), (3, 3, 2), (2, 2, 1), (4, 4, 1)}


@pytest.mark.parametrize("folder", ["in put", "50%", "a%20b", "k=v", "ümläut", "b[1]{x}*"])
def test_exact_batches_in_folders_of_any_name(spark, folder):
    at, data = scratch(spark, "state"), f"{scratch(spark, 'data')}/{folder}"
    every = []
    for k, rows in enumerate(([(1, "ab"), (2, "q")], [(3, "a b "), (4, "zz")], [(5, "ab"), (6, "q")])):
        every += rows
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{data}/{k}".replace("file:", ""))
        path = exact_dedup._readable(f"{data}/{k}".replace("%", "%25"))
        got = exact_dedup.dedup(spark.read.parquet(path), lambda t: F.length(t).cast("string"), state_dir=at, batch=f"b{k}").collect()
        groups = {}
        for d, t in every:
            groups.setdefault(t.replace(" ", ""), []).append((-len(t), d))
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(d, min(groups[t.replace(" ", "")])[1], len(groups[t.replace(" ", "")])) for d, t in every}


def test_exact_batches_with_colliding_digests(spark):
    """Three batches under a digest that makes different texts collide: as brute force over all rows, whichever batch a text came with."""
    at, every = scratch(spark, "state"), []
    low = -(1 << 63)
    for k, batch in enumerate(([(1, "ab"), (2, "q")], [(3, "xy"), (low, "a b ")], [(5, "ab"), (6, "xy"), (7, "zz")])):
        every += batch
        got = exact_dedup.dedup(spark.createDataFrame(batch, "doc_id long, text string"), lambda t: F.length(t).cast("string"), state_dir=at, batch=f"b{k}").collect()
        groups = {}
        for d, t in every:
            groups.setdefault(t.replace(" ", ""), []).append((-len(t), d))
        want = {(d, min(groups[t.replace(" ", "")])[1], len(groups[t.replace(" ", "")])) for d, t in every}
        assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == want and len(got) == len(every)


def test_columns_named_as_those_inside_stay(spark):
    rows = [(1, "a", "x", 7), (2, "a", "y", 8), (3, "b", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __sw_file string, __sw_row_ int").withColumn("__sw_row", F.lit("z"))
    for keep in (exact_dedup.keep_first, near_dedup.keep_one):
        out = keep(df)
        assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a", "x", 7, "z"), (3, "b", None, 9, "z")]


WORD = re.compile(r"[^\W_]+")


def weighted(texts):
    sets = [Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := WORD.findall((t or "").lower())) else Counter() for t in texts]
    df = Counter(s for c in sets for s in c)
    n, smooth = len(texts), near_dedup.SMOOTH
    return [{s: k * (1 + math.log((1 + smooth) / (df[s] / n + smooth))) for s, k in c.items()} for c in sets]


def plain_classes(texts, threshold=0.8):
    sets = weighted(texts)
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        least = sum(min(v, sets[b][s]) for s, v in sets[a].items() if s in sets[b])
        most = sum(sets[a].values()) + sum(sets[b].values()) - least
        if not most or least / most >= threshold:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    return [find(k) for k in range(len(texts))]


def test_near_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    want = {d.doc_id: docs[k].doc_id for d, k in zip(docs, plain_classes([d.text for d in docs]), strict=True)}
    got = near_dedup.op9_minhash_near_dedup(spark, SMALL).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_near_group_of_edited_copies(spark):
    """A large group with edits of all sizes: its buckets hold pairs on both sides of the threshold."""
    r = random.Random(5)
    base = [f"w{r.randrange(900)}" for _ in range(160)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(f"y{r.randrange(900)}" for _ in range(100)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.classes(df).collect()}
    want = plain_classes(texts)
    assert sum(got[k] != want[k] for k in range(len(texts))) <= 2  # a link at the threshold meets in a bucket with probability 0.998


def test_near_odd_rows(spark, odd, empty):
    got = near_dedup.classes(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.class_id, []).append(r)
    assert len(by[1]) == 4 and sum(r.kept for r in by[1]) == 1  # texts that differ in white space only are one text
    assert {r.doc_id for r in by[4]} == {4, 5, 6, None} and len(by[7]) == 2
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert near_dedup.classes(empty).count() == 0 and near_dedup.keep_one(empty).count() == 0


def test_sampling_estimates_weighted_similarity():
    counts = np.zeros(counters.COUNTERS, np.int64)
    words = lambda a, b: next(hashing.word_hashes([" ".join(f"w{k}" for k in range(a, b))]))
    counts[counters.counter_of(near_dedup.shingles(words(0, 200))[0])] = 500
    w = near_dedup.Weights(1000, counts)
    equal, alike = [], []
    for k in range(40):
        a, b = (w.weigh(*near_dedup.shingles(words(5 * k + x, 5 * k + x + 300))) for x in (0, 12))
        alike.append(near_dedup.similarity(a, b))
        equal += [x == y for x, y in zip(near_dedup.bands(*a), near_dedup.bands(*b), strict=True)]
        assert list(near_dedup.bands(*a)) == list(near_dedup.bands(*a))
    assert min(alike) < max(alike) < 1
    assert np.mean(equal) == pytest.approx(np.mean([s**near_dedup.ROWS for s in alike]), abs=0.06)  # a band needs all of its samples


def test_near_links_of_a_bucket_whatever_their_order(spark):
    """Points on a line, all in one bucket: the classes are those of the points less than 0.2 apart, and only part of the pairs is compared."""
    r = random.Random(7)
    points = {k: round(r.random() * 12, 3) for k in range(300)}
    asked = []

    def compare(pairs):
        rows = [(x.a, x.b, abs(points[x.a] - points[x.b])) for x in pairs.collect()]
        asked.append(len(rows))
        return spark.createDataFrame(rows, "a long, b long, distance double")

    def own(nodes):
        return nodes.select("node", F.lit(1.0).alias("all"), F.lit(0.0).alias("own"))

    members = spark.createDataFrame([(0, k) for k in points], "bucket long, node long")
    labels = {x.node: x.label for x in near_dedup.links(members, compare, own, 0.8).collect()}
    order = sorted(points, key=points.get)
    want, label = {}, order[0]
    for a, b in zip([None, *order], order, strict=False):
        if a is None or points[b] - points[a] > 0.2 + 1e-9:
            label = b
        want.setdefault(label, []).append(b)
    for group in want.values():
        assert {labels.get(k, k) for k in group} == {min(group)}
    assert sum(asked) < 300 * 299 / 4


@pytest.mark.parametrize("few", [True, False])
def test_near_classes_with_and_without_broadcast(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
        monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").select("text").collect()]
    assert near_dedup.classes(docs).where("kept").count() == len(set(plain_classes(texts)))
    assert exact_dedup.dedup(docs).where("kept").count() == len({"".join((t or "").split()) for t in texts})


def test_recall_on_a_larger_table(spark):
    """Of the pairs of sf0.01 that brute force links, at least 0.9 share a class; none of other classes do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    sets = weighted([d.text for d in docs])
    total, inside, at = [sum(s.values()) for s in sets], Counter(), {}
    for k, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(k)
    for x, rows in at.items():
        for a, b in itertools.combinations(rows, 2):
            inside[a, b] += min(sets[a][x], sets[b][x])
    linked = [p for p, n in inside.items() if n >= 0.8 * (total[p[0]] + total[p[1]] - n)]
    got = {r.doc_id: r.class_id for r in near_dedup.op9_minhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert len(linked) > 50 and sum(got[docs[a].doc_id] == got[docs[b].doc_id] for a, b in linked) >= 0.9 * len(linked)
    joined = {docs[k].doc_id for p in linked for k in p} | {d.doc_id for d, s in zip(docs, sets, strict=True) if not s}
    assert all(c == d or d in joined for d, c in got.items())


def test_word_hashes_of_blocks(monkeypatch):
    """Hashes depend on the word alone, wherever it stands and however texts are cut into blocks."""
    r, found = random.Random(1), {}
    texts = ["".join(r.choice("abcABC _é日İß0९ \n.,x") for _ in range(r.randrange(200))) for _ in range(200)] + ["a" * 500, "a" * 63, "b " * 200, ""]
    for block in (1 << 17, 64):
        monkeypatch.setattr(hashing, "BLOCK", block)
        hashing._usual_powers.cache_clear()
        for t, h in zip(texts, hashing.word_hashes(texts), strict=True):
            for word, x in zip(WORD.findall(t.lower()), h.tolist(), strict=True):
                assert found.setdefault(word, x) == x
    hashing._usual_powers.cache_clear()
    assert len(set(found.values())) == len(found)


def test_spotsigs_follow_the_next_document(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy(F.desc("doc_id")).collect()
    got = {r.doc_id: r for r in spotsigs.op7_spotsigs(spark, SMALL).collect()}
    assert len(got) == len(docs)
    one = lambda t: next(spotsigs.signatures([t]))
    for k, d in enumerate(docs):
        following = docs[(k + 1) % len(docs)].text
        other = spotsigs.edited(d.text, following)
        own, changed, theirs = (set(one(t).tolist()) for t in (d.text, other, following))
        r = got[d.doc_id]
        assert r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest() and r.n_chars == len(d.text)
        assert set(spotsigs.read(r.fingerprint).tolist()) == own and set(spotsigs.read(r.edited_fingerprint).tolist()) == changed
        assert r.near_edited == len(own & changed) / len(own | changed) and r.near_next == len(own & theirs) / len(own | theirs)
    odd_rows = spotsigs.fingerprints(odd).collect()
    assert len(odd_rows) == odd.count() and spotsigs.fingerprints(empty).count() == 0
    same = {r.fingerprint for r in odd_rows if r.doc_id in (1, 2)}
    assert len(same) == 1
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert spotsigs.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def shuffled_bytes(plan):
    """The largest number of bytes that one shuffle of a plan that has run wrote."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_bytes(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_bytes(plan.plan())
    if name == "ShuffleExchangeExec":
        return max(plan.metrics().apply("shuffleBytesWritten").value(), shuffled_bytes(plan.child()))
    below = plan.children()
    return max((shuffled_bytes(below.apply(k)) for k in range(below.size())), default=0)


def test_spotsigs_move_each_text_once_and_packed(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = spotsigs.fingerprints(docs)
    assert len(prints.collect()) == docs.count()
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0 < shuffled_bytes(prints._jdf.queryExecution().executedPlan()) < 0.55 * texts
    texts = [r.text or "" for r in odd.collect()]
    assert [spotsigs.unpacked(p, len(t.encode())) for p, t in zip(spotsigs.packed(pa.array(texts)).to_pylist(), texts, strict=True)] == texts


def test_signatures_against_plain_python():
    words = lambda t: WORD.findall(t.lower())
    texts = ["The cat and the dog sat on a mat of the house", "der Hund und die Katze gehen nach Hause", "no anchor", "", "the", "the the cat dog", "The Cat, and the DOG sat on a mat of the house!"]
    plain = []
    for t in texts:
        w = words(t)
        found = set()
        for k, x in enumerate(w):
            rest = [y for y in w[k + 1:] if y not in spotsigs.COMMON]
            if x in spotsigs.COMMON and len(rest) >= spotsigs.CHAIN:
                found.add((x, *rest[: spotsigs.CHAIN]))
        plain.append(found or {tuple(w)})
    made = [set(s.tolist()) for s in spotsigs.signatures(texts)]
    for a, b in itertools.combinations_with_replacement(range(len(texts)), 2):
        assert len(made[a] & made[b]) == len(plain[a] & plain[b])


def test_spotsigs_classes_match_brute_force(spark, odd, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    sets = list(spotsigs.signatures(d.text for d in docs))
    label = list(range(len(docs)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if spotsigs.likeness(sets[a], sets[b], 0.8) >= 0.8:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    want = {d.doc_id: docs[find(k)].doc_id for k, d in enumerate(docs)}
    got = {r.doc_id: (r.class_id, r.class_size) for r in spotsigs.op7_spotsigs(spark, SMALL).collect()}
    size = Counter(want.values())
    assert got == {d: (c, size[c]) for d, c in want.items()}
    assert spotsigs.matches(empty).count() == 0
    by = Counter(r.class_id for r in spotsigs.matches(odd).collect())
    assert sum(by.values()) == odd.count() and by[1] == 4 and by[4] == 4


def test_word_blocks_have_the_same_words(monkeypatch):
    """Words by bytes are those of the lowered text, equal if and only if their hashes are, wherever they stand and however texts are cut into blocks."""
    r, found = random.Random(3), {}
    texts = ["".join(r.choice("abcABC _éÉß日0९𝒳😀—ΑΣ\x00 \n.,x▁") for _ in range(r.randrange(200))) for _ in range(200)] + ["a" * 500, "é" * 63, "b " * 200, "İİ İ", "", "x😀y" * 40, "donau" * 5 + "1", "donau" * 5 + "2"]
    for block in (1 << 17, 64):
        monkeypatch.setattr(hashing, "BLOCK", block)
        made = [h[a:b] for h, counts in hashing.word_blocks(texts) for a, b in spotsigs.spans(counts)]
        for t, h in zip(texts, made, strict=True):
            for word, x in zip(WORD.findall(t.lower()), h.tolist(), strict=True):
                assert found.setdefault(word, x) == x
    assert len(set(found.values())) == len(found)


def test_signatures_and_meeting_keys_by_blocks(monkeypatch):
    """Signatures and keys are made block by block, a few calls for hundreds of texts, and are those that each text has alone."""
    r = random.Random(6)
    words = [*sorted(spotsigs.COMMON)[:30], *(f"w{k}" for k in range(200))]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(120))) for _ in range(300)] + ["", "the", "no anchor here", "the cat", "the cat sat", ""]
    rarity = np.random.default_rng(1).random(counters.COUNTERS).astype(np.float32)
    calls, one_call = [], spotsigs.signed
    monkeypatch.setattr(spotsigs, "signed", lambda *a, **b: calls.append(1) or one_call(*a, **b))
    together = list(spotsigs.signatures(texts))
    assert len(calls) < len(texts) // 10
    at, keys = 0, {}
    for w, counts in hashing.word_blocks(texts):
        own, sets = spotsigs.meeting_keys(*one_call(w, counts, rarity=rarity), 0.8)
        for k, of in zip(own.tolist(), sets.tolist(), strict=True):
            keys.setdefault(of + at, []).append(k)
        at += len(counts)
    for k, t in enumerate(texts):
        (w, counts), = hashing.word_blocks([t])
        s, weight, sizes = one_call(w, counts, rarity=rarity)
        assert s.tolist() == together[k].tolist() == sorted({*s.tolist()}) and sizes.tolist() == [len(s)]
        order = sorted(range(len(s)), key=lambda j: (-weight[j], s[j]))
        alone = spotsigs.meeting_keys(s, weight, sizes, 0.8)[0].tolist()
        assert sorted(keys[k]) == sorted(alone) and len({*alone}) == len(alone)
        n, prefix = len(s), spotsigs.prefix_size(len(s), 0.8)
        level = spotsigs.level_of(n, 0.8)
        salt = lambda v: hashing.mixed(np.array([v], np.uint64) * spotsigs._F[0])
        assert alone[:prefix] == hashing.mixed(s[order[:prefix]] + salt(level + 1)).tolist()
        assert {*alone[prefix:]} <= {*hashing.mixed(s[order] + salt(level + 2)).tolist()}


def test_spotsigs_workers_stay_small():
    """Workers import what tasks name; pandas alone takes 27 MB in each."""
    code = "import sys, sparkwell.llm.spotsigs; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
