"""Arrangements of texts, token alignment and the n-gram join, against SQL and brute force."""

import hashlib
import itertools
import pickle
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from sparkwell.llm import alignment, fill_middle, hashing, linking, ngram_join, sharing
from sparkwell.llm.common import located, vocabulary_path


def test_fill_middle_query_matches_sql(spark):
    assert rows_of_spark(fill_middle.op11_fill_in_middle(spark, SMALL)) == rows_of_duckdb(database(SMALL), fill_middle.ORACLE_SQL)


def plain_arranged(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_on_odd_rows(spark, odd, empty):
    more = [(100 + k, t) for k, t in enumerate(["\n", "\n\n\n", "a\n\nb", "x<P>y\n", "<", "<\n<P\n<S\n", "😀\n\r\n日\n", "P>\nS>\nM>", "a\nb\nc\nd\ne\nf\ng\n" * 40])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    done = fill_middle.transform(docs)
    got = done.withColumn("back", fill_middle.restored(F.col("arranged"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.arranged) for r in got) == Counter((d.doc_id, *plain_arranged(d.doc_id, d.text)) for d in docs.collect())
    assert Counter((r.doc_id, r.back) for r in got) == Counter((d.doc_id, d.text or "") for d in docs.collect())
    assert fill_middle.transform(empty).count() == 0
    assert {*odd.columns} <= {*fill_middle.transform(odd).columns}


def test_fill_middle_shares_and_marks(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("one\ntwo\nthree\nfour\n").alias("text"))
    how = fill_middle.Arrangement(seed=3, rate=60, spm=25, prefix="[pre]", suffix="[suf]", middle="[mid]")
    got = fill_middle.transform(docs, how).withColumn("back", fill_middle.restored(F.col("arranged"), F.col("form"), how)).collect()
    n = Counter(r.form for r in got)
    assert {r.back for r in got} == {"one\ntwo\nthree\nfour\n"} and 110 < n["plain"] < 210 and n["spm"] < n["psm"]
    with pytest.raises(ValueError):
        fill_middle.Arrangement(prefix="ab", suffix="ac", middle="aa")


def plain_alignment(rows):
    """Every pair of tokens tried, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    back = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def cut(tokens):
        out, at = [], 0
        for i, raw in tokens:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        return out

    docs = []
    for doc_id, text in rows:
        docs.append((doc_id, [], []))
        if not text:
            continue
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            docs[-1] = doc_id, cut(a), cut(b)
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] for _, a, b in docs]
    count = Counter(p for ls in links for p in {*ls})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, a, b), ls in zip(docs, links, strict=True):
        both = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, at = [], 0
        for e in both:
            groups.append(",".join(str(x[0]) for x in a if at < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if at < y[2] <= e))
            at = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), digest))
    return Counter(out)


@pytest.mark.parametrize("block,sent", [(16384, 10**6), (3, 0)])
def test_alignment_matches_brute_force(spark, odd, monkeypatch, block, sent):
    """Odd rows and real texts, with blocks of a few tokens and with counts joined by a shuffle."""
    monkeypatch.setattr(alignment, "BLOCK", block)
    real = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") < 400).select("doc_id", "text").limit(60)
    more = [(900 + k, t) for k, t in enumerate([" ", "  ", "a ", " a", "a  b   c\n\n d\t", "▁x", "<s>a</s> <|endoftext|> <0x0A>", "naïve Œuvre 日本語 😀😀", "it's 12345678 ... !!!", "\x00\x01", "a▁ b"])]
    docs = odd.select("doc_id", "text").where(F.length("text").isNull() | (F.length("text") < 1000)).union(spark.createDataFrame(more, "doc_id long, text string")).union(real)
    got = Counter(tuple(r) for r in alignment.alignment(docs, broadcast_pairs=sent).select(*alignment._RESULT).collect())
    assert got == plain_alignment([tuple(r) for r in docs.collect()])


def test_alignment_groups_and_links(spark, empty):
    r = random.Random(4)
    texts = ["".join(r.choice("abcdeü  \n.,1") for _ in range(r.randrange(1, 200))) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in alignment.alignment(docs).collect()}
    written = defaultdict(list)
    for g in sorted(alignment.groups(docs).collect(), key=lambda g: (g.doc_id, g.group)):
        written[g.doc_id].append(",".join(map(str, g.a_ids)) + "|" + ",".join(map(str, g.b_ids)))
    assert all(hashlib.sha256(";".join(written[d]).encode()).hexdigest() == w.groups_sha256 for d, w in whole.items())
    n = Counter(x.doc_id for x in alignment.links(docs).collect())
    assert all(n[d] == w.n_links == w.n_a + w.n_b - w.n_groups for d, w in whole.items())
    assert alignment.alignment(empty).count() == 0


BLANK = re.compile(r"[^ \t-\r]+")


def grams(text):
    w = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain_components(rows, percent=85):
    """(doc_id, size, component) of every pair compared."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), (True, 0)), (d is None, d or 0))
    return Counter((d, len(sets[k]), None if least[find(k)][0] else least[find(k)][1]) for k, (d, _) in enumerate(rows))


def components(docs):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect())


def test_ngram_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op13_ngram_join(spark, SMALL).collect()) == plain_components(docs)


def test_ngram_odd_rows(spark, odd, empty):
    more = [(100 + k, t) for k, t in enumerate(["a", "A", "a b", "A\tB", "a b c", "b a c", "a b c d", "a b c d e", "É é", "é É", "\x00", "x\u00a0y", " ", "a b c d a b c d a b c d a b c d"])]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    assert components(docs) == plain_components([tuple(r) for r in docs.collect()])
    assert ngram_join.joined(empty).count() == 0


def family(r, n, words=120, sets=6):
    """Texts with edits around the threshold, of all sizes, and a passage that unlike texts share."""
    passage = [f"p{k}" for k in range(60)]
    out = []
    for f in range(sets):
        base = [f"w{f}x{r.randrange(500)}" for _ in range(r.randrange(8, words))]
        for _ in range(n):
            t = list(base)
            for _ in range(r.randrange(0, max(2, len(t) // 18))):
                at = r.randrange(len(t))
                t[at:at + r.randrange(2)] = [f"e{r.randrange(10**6)}"]
            out.append(" ".join(t + passage * (f % 2) * r.randrange(2)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ngram_families_with_edits(spark, seed):
    docs = list(enumerate(family(random.Random(seed), 25)))
    assert components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == plain_components(docs)


def test_links_keep_no_sketches_with_members(spark, monkeypatch):
    """What is written for each member of a bucket stays narrow: sketches are written once for each node."""
    written, one = [], linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, what: written.append((what, df.columns)) or one(df, what))
    docs = list(enumerate(family(random.Random(0), 25)))
    assert components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == plain_components(docs)
    assert {"link-bounds", "link-state", "link-leaders"} <= {what for what, _ in written}
    assert {what for what, columns in written if len({*columns} & {f"{c}{s}" for c in linking._SKETCH for s in ("", "_b")})} == {"link-bounds"}


def test_ngram_shuffles_go_with_their_queries(spark):
    """No query leaves files of shuffles behind for the driver's garbage collection."""
    docs = spark.createDataFrame(list(enumerate(family(random.Random(1), 10))), "doc_id long, text string").repartition(3)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk, before = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(name)

    def files():
        found = disk.getAllFiles()
        return {f for f in (found.apply(k).getName() for k in range(found.size())) if f.startswith("shuffle_")}

    docs = located(docs)
    old = files()
    joined = ngram_join.joined(docs)
    for _ in range(50):  # they are removed by another thread
        left = files() - old
        if not left:
            break
        time.sleep(0.1)
    assert not left and joined.count() == 60 and spark.conf.get(name) == before


@pytest.mark.parametrize("least,width", [(1, 64), (40, 1 << 12)])
def test_ngram_wide_sketches_lose_no_link(spark, monkeypatch, least, width):
    """With wide sketches for all sets or the larger ones, of few or many parities, the components are those of all pairs."""
    monkeypatch.setattr(ngram_join, "WIDE_FROM", least)
    monkeypatch.setattr(linking, "WIDE", width)
    docs = list(enumerate(family(random.Random(5), 25)))
    assert components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)) == plain_components(docs)


def test_large_unlike_sets_are_not_moved(spark):
    """Pairs of sets that SKETCH parities can't tell apart are ruled out by wide ones before sets move."""
    r = np.random.default_rng(2)
    sets = {k: np.unique(r.integers(0, 1 << 64, 7000, np.uint64)) for k in range(4)}
    sets[4] = np.sort(np.append(sets[0][:-300], r.integers(0, 1 << 64, 300, np.uint64)))
    small = {5: sets[1][:30]}
    bounds = spark.createDataFrame([(k, len(s), bytearray(linking.sketch_of(s, linking.WIDE).tobytes())) for k, s in sets.items()] + [(k, len(s), None) for k, s in small.items()], "node long, all long, wide binary")
    pairs = spark.createDataFrame([*itertools.combinations(range(6), 2)], "a long, b long")
    found = linking.Sets(None, None, 2048).possible(pairs, bounds, 0.85)
    assert {tuple(x) for x in found.collect()} == {(0, 4), *((k, 5) for k in range(5))}
    narrow = {k: linking.sketch_of(s, linking.SKETCH) for k, s in sets.items()}
    assert all(np.bitwise_count(narrow[a] ^ narrow[b]).sum() <= linking.most_apart(0.85, 14_000) for a, b in itertools.combinations(sets, 2))


def test_marks_stay_rare_and_bitmaps_small():
    """Of many keys that aren't marked few look as if they were; what is sent of bitmaps with few bits set is small."""
    r = np.random.default_rng(3)
    marked, others = (r.integers(0, 1 << 64, n, np.uint64) for n in (50_000, 2_000_000))
    marks = np.zeros(1 << 21, np.uint8)
    sharing.mark(marked, marks)
    bitmap = np.zeros(1 << 21, np.uint8)
    bitmap[::1000] = 1
    sent = pickle.dumps(sharing.Shared(bitmap, 24, marks))
    shared = pickle.loads(sent)
    assert len(sent) < 400_000 and (shared.bitmap == bitmap).all() and (shared.marks == marks).all() and shared.any_marks
    assert shared.marked(marked).all() and shared.marked(others).sum() < 300


def test_ngram_pigeonhole_holds_for_any_costs():
    """Every pair of partners meets in a key that the larger one asks for, whatever segments are thought costly."""
    r = np.random.default_rng(1)
    percent, left_out = 85, 0
    for _ in range(1500):
        n = int(r.integers(1, 120))
        big = np.unique(r.integers(1, 1 << 62, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, n * 15 // 100) + 1))
        small = big[np.sort(r.permutation(len(big))[: len(big) - drop])]
        swap = int(r.integers(0, max(1, len(small) // 12)))
        small = np.unique(np.append(small[swap:], r.integers(1, 1 << 62, min(swap, drop)).astype(np.uint64)))
        both = len(np.intersect1d(big, small))
        if not len(small) or 100 * both < percent * (len(big) + len(small) - both) or len(small) > len(big):
            continue
        costs = {}

        def held(keys):
            return np.array([costs.setdefault(int(k), float(r.choice([0, 0, 0, 300]))) for k in keys])

        asks = ngram_join.Keys(big, percent, held)
        index = ngram_join.Keys(small, percent, held)
        left_out += len(asks.around)
        wants = {*asks.keys[asks.asks].tolist()} | {*asks.around.tolist()}
        assert wants & ({*np.concatenate([c.keys for c in index.cuts]).tolist()} | {*index.index_around().tolist()})
    assert left_out > 50


def test_ngram_keys_by_blocks(monkeypatch):
    """Sets are cut block by block, a few cuts for hundreds of texts, and have the keys that each has alone."""
    r = random.Random(4)
    texts = [*family(r, 50), "", " ", "a", "A b", "a b c", "a b c d", "a b c d " * 30, " ".join(f"z{k}" for k in range(30_000)), ""]
    sets = list(ngram_join.sets_of(texts))
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts]
    assert all((s[1:] > s[:-1]).all() and s.tolist() == next(ngram_join.sets_of([t])).tolist() for s, t in zip(sets, texts, strict=True))

    def held(keys):
        return np.where(keys % np.uint64(7) == 0, 300.0, 0.0)

    def marked(keys):
        return keys % np.uint64(5) == 0

    cuts, cut = [], ngram_join.Cut
    monkeypatch.setattr(ngram_join, "Cut", lambda *a: cuts.append(1) or cut(*a))
    together = defaultdict(lambda: (set(), set(), set()))
    for k, of in ngram_join._keys(texts, 85, held):
        for owner, key, asks in zip(of[k.set].tolist(), k.keys.tolist(), k.asks.tolist(), strict=True):
            together[owner][0].add((key, asks))
        for owner, key in zip(of[k.around_set].tolist(), k.around.tolist(), strict=True):
            together[owner][1].add(key)
        for key, asks, owner in zip(*(x.tolist() for x in k.around_of(marked)), strict=True):
            together[int(of[owner])][2].add((key, asks))
    assert len(cuts) < len(texts) // 10
    for at, s in enumerate(sets):
        if len(s):
            k = ngram_join.Keys(s, 85, held)
            index = k.index_around()
            around = {*k.around.tolist()}
            near = {(x, x in around) for x in {*index[marked(index)].tolist()} | around}
            assert together[at] == ({*zip(k.keys.tolist(), k.asks.tolist(), strict=True)}, around, near)
    assert {*together} == {at for at, s in enumerate(sets) if len(s)} and sum(len(x[1]) for x in together.values()) > 50


def test_ngram_words_by_blanks():
    r = random.Random(2)
    texts = ["".join(r.choice("aAbÉ \t\n\x0b\x1f\u00a0") for _ in range(r.randrange(0, 60))) for _ in range(300)] + ["", "ab " * 90_000, "x" * 300_000 + " y", "x" * 300_000 + " y"]
    seen = {}
    for t, h in zip(texts, hashing.blank_word_hashes(texts), strict=True):
        words = BLANK.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        assert len(words) == len(h) and all(seen.setdefault(w, int(x)) == int(x) for w, x in zip(words, h, strict=True))
    assert len({*seen.values()}) == len(seen)
