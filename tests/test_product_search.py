"""Product search against a plain double loop over searches and terms."""

import random

import pytest
import regex
from compare import SMALL

from sparkwell.operators import product_search as ps


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def alike(a, b):
    pairs = ((a, b), (ps.sorted_words(a), ps.sorted_words(b)))
    return max(200.0 * lcs(x, y) / (len(x) + len(y)) for x, y in pairs)


def plain(text):
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", (text or "").lower()).strip()


def term_score(q, t):
    scores = [0.0]
    if q == t:
        scores.append(100.0)
    if t in q:
        scores.append(95.0 if f" {t} " in f" {q} " else 85.0)
    if len(q) >= 3 and q in t:
        scores.append(90.0)
    words, w = q.split(), len(t.split())
    runs = {q} | {" ".join(words[i:i + k]) for k in (w - 1, w, w + 1) if k > 0 for i in range(len(words) - k + 1)}
    return max(scores + [s for s in (alike(r, t) for r in runs if min(len(r), len(t)) * 13 >= max(len(r), len(t)) * 7) if s >= 70])


def brute(queries, products, aliases, categories):
    cat, out = {}, set()
    for p, c in products:
        if p is not None:
            cat[p] = min((x for x in (cat.get(p), c) if x is not None), default=None)
    groups = sorted({(c, plain(w)) for w, c in categories if plain(w) and c is not None})
    memo = {}
    for qid, q in queries:
        if qid is None:
            continue
        q = plain(q)
        if q not in memo:
            near = [(q != w, c, w) for c, w in groups if q and alike(q, w) >= 75]
            mine = min(near)[1] if near else None
            found = {}
            for p, a in aliases:
                t = plain(a)
                if q and t and p in cat and (mine is None or cat[p] != mine):
                    s = term_score(q, t)
                    if s >= 70:
                        found[p] = max(found.get(p, 0.0), s)
            found |= {p: 88.0 for p in cat if mine is not None and cat[p] == mine}
            top = max(found.values(), default=0)
            memo[q] = {p: s for p, s in found.items() if top < 90 or s >= top - 5}
        kept = memo[q]
        status = "unknown" if not kept else "product" if len(kept) == 1 else "ambiguous"
        out |= {(qid, p, round(s, 6), status) for p, s in kept.items()} or {(qid, None, None, status)}
    return out


def rows(df):
    got = [(r.query_id, r.product_id, None if r.score is None else round(r.score, 6), r.status) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def frames(spark, queries, products, aliases, categories):
    return (
        spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(products, "product_id long, category string"),
        spark.createDataFrame(aliases, "product_id long, alias string"), spark.createDataFrame(categories, "word string, category string"),
    )


@pytest.mark.parametrize("seed", [1, 2])
def test_search_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    syllables = ["ra", "do", "mi", "sol", "fé", "बीज", "lu", "t"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(40)]
    name = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, n)))
    products = [(k, rng.choice(["seeds", "tools", "oils", None])) for k in range(50)] + [(7, "seeds"), (None, "tools")]
    aliases = [(rng.randint(0, 52), name(3)) for _ in range(100)] + [(3, None), (4, "  "), (None, "rado"), (5, "x" * 40 + " " + "yz" * 30)]

    def typo(t):
        k = rng.randrange(len(t))
        return rng.choice([t[:k] + t[k + 1:], t[:k] + rng.choice("aeé ") + t[k:], t[::-1], f"so, {t} now!", t.upper()])

    queries = [(f"q{k}", typo(rng.choice(aliases[:100])[1])) for k in range(80)] + [(f"w{k}", name(6)) for k in range(20)]
    queries += [("empty", ""), ("null", None), (None, "rado"), ("marks", "?!"), ("long", "x" * 41 + " " + "yz" * 29), ("page", " ".join(name(9) for _ in range(60))), ("c", "tols"), ("d", "seeds"), ("q1", "seeds")]
    categories = [("seeds", "seeds"), ("toolz", "tools"), ("बीज", "seeds"), (None, "oils"), ("oil", None), ("oils", "oils")]
    data = (queries, products, aliases, categories)
    want = brute(*data)
    got = rows(ps.search(*frames(spark, *data)))
    assert (got - want, want - got) == (set(), set())
    assert {s for *_, s in want} == {"unknown", "product", "ambiguous"}


def test_empty_tables(spark):
    some = ([("q", "rado")], [(1, "seeds")], [(1, "rado")], [("seeds", "seeds")])
    for k in range(4):
        data = [rows_ if i != k else [] for i, rows_ in enumerate(some)]
        assert rows(ps.search(*frames(spark, *data))) == brute(*data)


def test_blocks_are_of_bounded_size_and_lose_nothing(spark):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(1, 90))).strip() or "e" for _ in range(700)})
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    blocks = [r["items"] for r in ps._blocks(df, 80.0).collect()]
    assert sorted(t for b in blocks for t in b) == texts
    assert all(len(b) <= ps.BLOCK and (len(b) == 1 or sum(map(len, b)) <= ps.BLOCK_CHARS) for b in blocks)
    some = texts[::9]
    got = {(r.a, r.b): round(r.score, 6) for r in ps.alike(df.limit(1000), spark.createDataFrame([(t,) for t in some], "b string"), 80.0).collect()}
    want = {(a, b): round(s, 6) for a in texts for b in some if min(len(a), len(b)) * 1.5 >= max(len(a), len(b)) and (s := alike(a, b)) >= 80}
    assert got == want


def test_registered_query_matches_brute_force(spark):
    got = rows(ps.fuz02_product_search(spark, SMALL))
    parts = spark.read.parquet(f"{SMALL}/part.parquet").collect()
    first = {}
    for r in parts:
        first[r.p_name] = min(first.get(r.p_name, r.p_partkey), r.p_partkey)
    products = [(k, n.split(" ")[-1]) for n, k in first.items()]
    aliases = [(k, a) for n, k in first.items() for a in (n, " ".join(n.split(" ")[::-1]))]
    queries = []
    for r in parts:
        n, k, cut = r.p_name, r.p_partkey, r.p_partkey % 4 + 2
        typed = {1: n[:cut] + n[cut + 1:], 2: n[:cut] + n[cut - 1:], 3: f"Please find the {n}!", 4: n.split(" ")[-1] + "s", 5: n[:5], 6: r.p_type.lower()}.get(k % 7, n.upper())
        queries.append((f"part-{k}", typed))
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").where("length(text) < 150").collect():
        queries.append((f"message-{r.conv_id}-{r.turn}", r.text))
    want = brute(queries, products, aliases, [(c, c) for _, c in products])
    assert want <= got and {w[0] for w in got} - {w[0] for w in want} and {r for r in got if r[0].startswith("part")} == {r for r in want if r[0].startswith("part")}
