"""Searches for products by their names and aliases, a whole table of searches at a time.

Scores are kept for pairs of a search and a term that are different strings, each once: equal 100, the term as
whole words of the search 95, the search (three characters or more) inside the term 90, the term inside a word of the search
85, else what is alike. The first is a join by the string, the next three are places of passages (`passages.contained`). Alike are the
search or a run of its words, about as many as the term has, and the term, in their order or with words sorted, from
`least` on. A search that names a category finds that category's products at 88 and others by their terms.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.operators.passages import contained
from sparkwell.operators.sequences import lcs_ratio
from sparkwell.plans.views import view
from sparkwell.shared import written

#: Scores of the tiers, the bound of alike terms and category words, and how far below a sure hit others may be.
EXACT, WORDS, INSIDE, PART, CATEGORY = 100.0, 95.0, 90.0, 85.0, 88.0
LEAST, LEAST_CATEGORY, SURE, GAP = 70.0, 75.0, 90.0, 5.0

#: Strings and characters of a block, classes letters are counted in, and shares that a length's blocks are dealt to.
BLOCK, BLOCK_CHARS, LETTERS, SALT = 128, 4096, 64, 16


def normal(text: Column) -> Column:
    """Lower case, anything but letters, marks and digits a single space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))


def sorted_words(text: str) -> str:
    """The words in order, all blanks kept, so that lengths and letters stay as they are."""
    return " ".join(sorted(text.split(" ")))


class _Side:
    """Strings of a block: code points in rows, lengths, letters counted by class."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.codes = np.zeros((len(texts), max(1, int(self.size.max()))), np.uint32)
        self.letters = np.zeros((len(texts), LETTERS), np.int32)
        for k, t in enumerate(texts):
            c = np.frombuffer(t.encode("utf-32-le"), "<u4")
            self.codes[k, : len(c)] = c
            self.letters[k] = np.bincount(c % LETTERS, minlength=LETTERS)


def _lcs(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Longest common subsequences of strings i of a and strings j of b, which have 64 characters or fewer; all pairs at once, a bit a character."""
    alphabet, at = np.unique(np.concatenate((a.codes.ravel(), b.codes.ravel())), return_inverse=True)
    at_a, at_b = at[: a.codes.size].reshape(a.codes.shape), at[a.codes.size :].reshape(b.codes.shape)
    masks = np.zeros((len(b.texts), len(alphabet)), np.uint64)
    for p in range(min(64, b.codes.shape[1])):
        rows = np.flatnonzero(b.size > p)
        masks[rows, at_b[rows, p]] |= np.uint64(1) << np.uint64(p)
    v = np.full(len(i), ~np.uint64(0))
    for p in range(int(a.size[i].max(initial=0))):
        u = v & masks[j, at_a[i, p]]
        v = np.where(a.size[i] > p, (v + u) | (v - u), v)
    used = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - b.size[j].astype(np.uint64))
    return np.bitwise_count(~v & used).astype(np.int64)


def _compared(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """i, j and score of those pairs of strings i of a and j of b that are alike, words as they are or sorted."""
    short = b.size[j] <= 64
    for x, y in zip(i[~short].tolist(), j[~short].tolist(), strict=True):
        s, t = a.texts[x], b.texts[y]
        score = max(lcs_ratio(s, t), lcs_ratio(sorted_words(s), sorted_words(t)))
        if score >= least:
            yield x, y, score
    i, j = i[short], j[short]
    if len(i):
        sa, sb = (_Side([sorted_words(t) for t in side.texts]) for side in (a, b))
        score = 200.0 * np.maximum(_lcs(a, b, i, j), _lcs(sa, sb, i, j)) / (a.size[i] + b.size[j])
        for k in np.flatnonzero(score >= least).tolist():
            yield int(i[k]), int(j[k]), float(score[k])


class _Bound:
    """Which strings may be alike by the letters that they share: a row of letter counts becomes ones at each (letter, n) it has n or more of, so that a product of matrices counts what is shared."""

    def __init__(self, b: _Side):
        most = b.letters.max(axis=0)
        self.letter = np.repeat(np.arange(LETTERS), most)
        self.least = np.concatenate([np.arange(1, n + 1) for n in most])
        self.ones, self.size = self._ones(b.letters).T, b.size

    def _ones(self, letters: np.ndarray) -> np.ndarray:
        return (letters[:, self.letter] >= self.least).astype(np.float32)

    def pairs(self, letters: np.ndarray, size: np.ndarray, chosen: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        shared = self._ones(letters) @ self.ones[:, chosen]
        i, j = np.nonzero(200.0 * shared >= least * (size[:, None] + self.size[chosen][None, :]))
        return i, chosen[j]


def _run_hits(queries: list[str], terms: list[str], least: float) -> dict[tuple[int, int], float]:
    """The best score of each query and term by their numbers: the query itself, and its runs of about as many words as the term has."""
    b = _Side(terms)
    bound, n_words = _Bound(b), np.array([t.count(" ") + 1 for t in terms])
    split = [q.split(" ") for q in queries]
    words = [w for s in split for w in s]
    owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64) % LETTERS
    letters = np.bincount(np.repeat(np.arange(len(words)), size) * LETTERS + codes, minlength=len(words) * LETTERS).reshape(-1, LETTERS)
    best: dict[tuple[int, int], float] = {}

    def keep(owners: np.ndarray, i: np.ndarray, j: np.ndarray, text) -> None:
        if len(i):
            rows, at = np.unique(i, return_inverse=True)
            a = _Side([text(k) for k in rows.tolist()])
            for x, y, score in _compared(a, b, at, j, least):
                pair = (int(owners[rows[x]]), y)
                best[pair] = max(score, best.get(pair, 0.0))

    whole = np.array([len(q) for q in queries], np.int64)
    first = np.searchsorted(owner, np.arange(len(queries)))
    own = np.add.reduceat(letters, first, axis=0)
    own[:, ord(" ") % LETTERS] += np.array([len(s) - 1 for s in split])
    some = np.flatnonzero(whole * least <= int(b.size.max()) * (200.0 - least))
    i, j = bound.pairs(own[some], whole[some], np.arange(len(terms)), least)
    keep(np.arange(len(queries)), some[i], j, lambda k: queries[k])
    sums, lengths = letters.copy(), size.copy()
    for k in range(1, min(int(n_words.max()) + 1, len(words)) + 1):
        if k > 1:
            sums, lengths = sums[:-1] + letters[k - 1:], lengths[:-1] + size[k - 1:] + 1
            sums[:, ord(" ") % LETTERS] += 1
        rows = np.flatnonzero((owner[: len(lengths)] == owner[k - 1:]) & (lengths * least <= int(b.size.max()) * (200.0 - least)))
        i, j = bound.pairs(sums[rows], lengths[rows], np.flatnonzero(np.abs(n_words - k) <= 1), least)
        keep(owner, rows[i], j, lambda at, k=k: " ".join(words[at:at + k]))
    return best


def _blocks(texts: DataFrame, least: float) -> DataFrame:
    """band and items: the strings of each task in blocks of about one length. Strings that can be alike are a band apart at most."""
    step = np.log((200.0 - least) / least) + 1e-9

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[str]] = {}
        chars: dict[int, int] = {}

        def block(band: int) -> pa.RecordBatch:
            chars.pop(band)
            return pa.RecordBatch.from_arrays([pa.array([band], pa.int32()), pa.array([held.pop(band)], pa.list_(pa.string()))], ["band", "items"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                band = int(np.log(len(t)) / step)
                if band in held and (len(held[band]) >= BLOCK or chars[band] + len(t) > BLOCK_CHARS):
                    yield block(band)
                held.setdefault(band, []).append(t)
                chars[band] = chars.get(band, 0) + len(t)
        for band in list(held):
            yield block(band)

    return texts.mapInArrow(packed, "band int, items array<string>")


def alike(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b and score: pairs of strings of left (a) and right (b), different ones each, whose 200 * LCS / (|a| + |b|) is least or more, words as they are or sorted.

    Blocks of strings meet where their lengths allow it; of two blocks all pairs are bounded by their common letters and
    compared at once, and only pairs that are alike leave the task. Null and empty strings are like nothing.
    """
    if not 50 <= least <= 100:
        raise ValueError("least must be from 50 to 100")
    texts = lambda df, c: df.select(c).where(f"{c} <> ''").distinct()
    longest = right.agg(F.coalesce(F.max(F.length("b")), F.lit(0))).first()[0]
    la = _blocks(texts(left, "a").where(F.length("a") * least <= longest * (200.0 - least)), least).withColumn("salt", F.pmod(F.xxhash64("items"), F.lit(SALT)))
    salts, bands = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALT)))), F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))
    rb = _blocks(texts(right, "b"), least).select("items", salts.alias("salt"), "band").select(F.col("items").alias("others"), "salt", bands.alias("band"))
    both = la.join(rb, ["band", "salt"]).select("items", "others")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("items"), batch.column("others"), strict=True):
                a, b = x.as_py(), y.as_py()
                sa, sb = _Side(a), _Side(b)
                found = list(_compared(sa, sb, *_Bound(sb).pairs(sa.letters, sa.size, np.arange(len(b)), least), least))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([a[i] for i, _, _ in found]), pa.array([b[j] for _, j, _ in found]), pa.array([s for *_, s in found])], ["a", "b", "score"])

    return both.mapInArrow(compare, "a string, b string, score double")


def _gathered(texts: DataFrame, chars: int) -> DataFrame:
    """items: the one or two columns of texts in blocks of up to so many characters, longer texts alone; nothing moves."""
    fields = texts.columns

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, ...]] = []
        n = 0
        block = lambda: pa.RecordBatch.from_arrays([pa.array([list(c)], pa.list_(pa.string())) for c in zip(*held, strict=True)], fields)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in fields), strict=True):
                if held and n + len(row[-1]) > chars:
                    yield block()
                    held, n = [], 0
                held.append(row)
                n += len(row[-1])
        if held:
            yield block()

    return texts.mapInArrow(packed, ", ".join(f"{c} array<string>" for c in fields))


def runs_alike(queries: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """key, term and score: searches (key, query) of which the whole, or a run of about as many words as a term has, is alike that term.

    Runs are made in the task that compares them, so that each text moves once however many runs it has.
    """
    left = _gathered(queries.select("key", "query"), 2 * BLOCK_CHARS).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)))
    right = _gathered(terms.select("term"), BLOCK_CHARS).select("term", F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALT)))).alias("salt"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, z in zip(*(batch.column(c) for c in ("key", "query", "term")), strict=True):
                keys, names = x.as_py(), z.as_py()
                found = _run_hits(y.as_py(), names, least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in found]), pa.array([names[j] for _, j in found]), pa.array(list(found.values()))], ["key", "term", "score"])

    return left.join(right, "salt").select("key", "query", "term").mapInArrow(compare, "key string, term string, score double")


def term_hits(queries: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """key, term and score: the best score of each search (key, query) and term, in normal form, no search and no term twice."""
    terms = written(terms.select("term").where("term <> ''").distinct(), "search-terms")
    longest = terms.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0]
    exact = queries.join(terms, F.col("query") == F.col("term")).select("key", "term", F.lit(EXACT).alias("score"))
    padded = F.concat(F.lit(" "), "query", F.lit(" "))
    inside = contained(terms.select(F.col("term").alias("passage_id"), F.col("term").alias("passage")), queries.select(F.col("key").alias("doc_id"), padded.alias("text")))
    edge = lambda at: F.substring(padded, at.cast("int"), F.lit(1)) == " "
    said = inside.join(queries, F.col("doc_id") == F.col("key")).select("key", F.col("passage_id").alias("term"), F.when(edge(F.col("start")) & edge(F.col("stop") + 1), WORDS).otherwise(PART).alias("score"))
    short = queries.where((F.length("query") >= 3) & (F.length("query") <= longest))
    within = contained(short.select(F.col("key").alias("passage_id"), F.col("query").alias("passage")), terms.select(F.col("term").alias("doc_id"), F.col("term").alias("text")))
    within = within.select(F.col("passage_id").alias("key"), F.col("doc_id").alias("term"), F.lit(INSIDE).alias("score"))
    near = runs_alike(queries, terms, least)
    return exact.unionByName(said).unionByName(within).unionByName(near).groupBy("key", "term").agg(F.max("score").alias("score"))


def search(queries: DataFrame, products: DataFrame, aliases: DataFrame, categories: DataFrame, least: float = LEAST) -> DataFrame:
    """query_id, product_id, score and status of each search (query_id, query): its products, 'product' if there is one, 'ambiguous' if more, or one row without a product and 'unknown'.

    products: product_id, category. aliases: product_id, alias. categories: word, category. The word that a search equals, else the
    first in order of (category, word) that is alike by 75, gives its category. From a score of 90 on, only products within 5 of the best stay. Searches
    without an id are left out, those without text unknown, repeated ones one row; aliases of products that aren't there don't count.
    """
    queries = queries.where("query_id is not null").select("query_id", normal(F.col("query")).alias("query"))
    queries = written(queries.withColumn("key", F.sha1("query")), "search-queries")
    products = products.where("product_id is not null").groupBy("product_id").agg(F.min("category").alias("category"))
    named = aliases.select("product_id", normal(F.col("alias")).alias("term")).where("term <> ''").distinct().join(products, "product_id")
    groups = categories.select(normal(F.col("word")).alias("word"), "category").where("word <> '' and category is not null").distinct()
    asked = queries.select("key", "query").where("query <> ''").distinct()
    close = alike(asked.select(F.col("query").alias("a")), groups.select(F.col("word").alias("b")), LEAST_CATEGORY)
    close = close.join(groups, F.col("b") == F.col("word")).select(F.sha1("a").alias("key"), "category", F.struct(F.col("a") != F.col("b"), "category", "word").alias("o"))
    category = written(close.groupBy("key").agg(F.min_by("category", "o").alias("category")), "search-categories")
    hits = term_hits(asked, named.select("term"), least).join(named, "term").groupBy("key", "product_id", F.col("category").alias("own")).agg(F.max("score").alias("score"))
    hits = hits.join(category, "key", "left").where("category is null or category <> own or own is null").select("key", "product_id", "score")
    every = category.join(products, "category").select("key", "product_id", F.lit(CATEGORY).alias("score"))
    found = written(hits.unionByName(every), "search-hits")
    top = found.groupBy("key").agg(F.max("score").alias("top"))
    kept = found.join(top, "key").where((F.col("top") < SURE) | (F.col("score") >= F.col("top") - GAP))
    kept = kept.join(kept.groupBy("key").agg(F.count("*").alias("n")), "key").select("key", "product_id", "score", "n")
    status = F.when(F.col("n").isNull(), "unknown").when(F.col("n") == 1, "product").otherwise("ambiguous")
    return queries.select("query_id", "key").distinct().join(kept, "key", "left").select("query_id", "product_id", "score", status.alias("status"))


def fuz02_product_search(spark, sf_dir):
    """Names of parts as products, also known by their words the other way round, the last word as the category. Searches are typed after every part (as it is, a letter missing or doubled, words around it, the category, a part of a word), and every message is one."""
    p = view(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    products = p.groupBy("p_name").agg(F.min("p_partkey").alias("product_id")).withColumn("category", F.element_at(words, -1))
    aliases = products.select("product_id", F.explode(F.array("p_name", F.array_join(F.reverse(words), " "))).alias("alias"))
    k, last = F.col("p_partkey"), F.element_at(words, -1)
    cut = (k % 4 + 2).cast("int")
    lost = F.concat(F.substring("p_name", F.lit(1), cut), F.substring("p_name", cut + 2, F.lit(99)))
    doubled = F.concat(F.substring("p_name", F.lit(1), cut), F.substring("p_name", cut, F.lit(99)))
    typed = F.when(k % 7 == 1, lost).when(k % 7 == 2, doubled).when(k % 7 == 3, F.concat(F.lit("Please find the "), "p_name", F.lit("!"))).when(k % 7 == 4, F.concat(last, F.lit("s"))).when(k % 7 == 5, F.substring("p_name", 1, 5)).when(k % 7 == 6, F.lower("p_type")).otherwise(F.upper("p_name"))
    asked = p.select(F.concat(F.lit("part-"), k.cast("string")).alias("query_id"), typed.alias("query"))
    said = view(spark, sf_dir, "messages").select(F.format_string("message-%d-%d", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    categories = products.select(F.col("category").alias("word"), "category").distinct()
    return search(asked.unionByName(said), products, aliases, categories)


QUERIES = {"fuz02_product_search": fuz02_product_search}
SQL: dict[str, str] = {}
