"""The best documents of each question by BM25, without a row for each question and document.

Documents are cut into words once; what stays is a narrow row for each: its length and how often it has each term that is asked
for. Every task scores its documents in blocks against all questions and keeps, for each question, what may be among
its best k. A question's terms are ordered by the most that each can add within the block. Those that together
cannot lift a document over the question's k-th best score so far don't bring in documents; they are only looked
up for documents that its other terms bring in. So a term that nearly all documents have costs a lookup, not a row.

Questions are sent to the tasks in blocks of SENT terms; each further block reads the documents again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.functions.text import words
from sparkwell.shared import written

# The usual saturation and length normalization.
K1, B = 1.5, 0.75
#: Rows of (question, term) that are sent at once; documents of a block.
SENT, BLOCK = 1_000_000, 4096
#: Scores that differ by less may be equal when they are rounded.
NEAR = 1e-5


class _Questions:
    """Questions by number, with their terms (by number) and how often each counts."""

    def __init__(self, rows: pa.Table, once: bool):
        self.items, question = np.unique(rows.column("item_id").to_numpy(zero_copy_only=False), return_inverse=True)
        self.terms = pa.array(sorted(set(rows.column("term").to_pylist())), pa.string())
        term = pc.index_in(rows.column("term").combine_chunks(), value_set=self.terms).to_numpy()
        times = np.ones(len(term)) if once else rows.column("tf").to_numpy().astype(np.float64)
        order = np.argsort(question, kind="stable")
        cuts = np.searchsorted(question[order], np.arange(len(self.items) + 1))
        self.asked = [(term[order[a:b]], times[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class _Best:
    """The documents that may be among the best k of one question."""

    def __init__(self, k: int):
        self.k, self.floor = k, -np.inf
        self.scores, self.docs = np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        keep = scores >= self.floor - NEAR
        self.scores, self.docs = np.concatenate((self.scores, scores[keep])), np.concatenate((self.docs, docs[keep]))
        if len(self.scores) > self.k:
            self.floor = np.partition(self.scores, -self.k)[-self.k]
            keep = self.scores >= self.floor - NEAR
            self.scores, self.docs = self.scores[keep], self.docs[keep]


def score_block(asked: list[tuple[np.ndarray, np.ndarray]], best: dict[int, _Best], k: int, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> int:
    """Score a block of documents (ids) by its postings (doc, term, weight); the number of documents that were looked at, over all questions."""
    order = np.argsort(term, kind="stable")
    term, doc, weight = term[order], doc[order], weight[order]
    known, first = np.unique(term, return_index=True)
    ends = np.append(first[1:], len(term))
    most = np.maximum.reduceat(weight, first) if len(first) else weight
    dense: dict[int, np.ndarray] = {}
    score, looked = np.zeros(len(ids)), 0
    for q, (terms, times) in enumerate(asked):
        at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
        ok = known[at] == terms if len(known) else np.zeros(len(terms), bool)
        if not ok.any():
            continue
        at, times = at[ok], times[ok]
        bound = most[at] * times
        by = np.argsort(bound, kind="stable")
        at, times, bound = at[by], times[by], np.cumsum(bound[by])
        own = best.setdefault(q, _Best(k))
        low = int(np.searchsorted(bound, own.floor - NEAR)) if len(own.scores) >= k else 0  # terms that don't bring in documents
        if low == len(at):
            continue
        for t, x in zip(at[low:], times[low:], strict=True):
            score[doc[first[t]:ends[t]]] += x * weight[first[t]:ends[t]]
        found = np.unique(np.concatenate([doc[first[t]:ends[t]] for t in at[low:]]))
        total = score[found]
        score[found] = 0.0
        for t, x in zip(at[:low], times[:low], strict=True):
            if t not in dense:
                dense[t] = np.zeros(len(ids))
                dense[t][doc[first[t]:ends[t]]] = weight[first[t]:ends[t]]
            total += x * dense[t][found]
        looked += len(found)
        own.add(total, ids[found])
    return looked


def _best(asked: DataFrame, docs: DataFrame, k: int, once: bool) -> DataFrame:
    spark = docs.sparkSession
    questions = _Questions(asked.toArrow(), once)
    if not len(questions.items):
        return spark.createDataFrame([], "item_id long, doc_id long, score double")
    sent = spark.sparkContext.broadcast(questions)
    known = len(questions.terms)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value.terms
        for b in batches:
            w = b.column("w")
            n = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.index_in(w.flatten(), value_set=vocabulary)
            doc, mine = np.repeat(np.arange(len(n)), n), term.is_valid().to_numpy(zero_copy_only=False)
            key, tf = np.unique(doc[mine] * known + term.drop_null().to_numpy(), return_counts=True)
            offsets = np.searchsorted(key // known, np.arange(len(n) + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % known, tf))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), *lists], ["doc_id", "dl", "terms", "tfs"])

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(words(F.col("text"), True), F.array().cast("array<string>")).alias("w"))
    postings = written(cut.mapInArrow(count, "doc_id long, dl long, terms array<int>, tfs array<int>"), "ranking-postings")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(known, np.int64)
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(), minlength=known)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    stats = postings.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    got = postings.select("terms").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term asked for
    df = np.zeros(known)
    df[got.column("term").to_numpy()] = got.column("df").to_numpy()
    idf, average = np.log(1 + (stats.n - df + 0.5) / (df + 0.5)), max(stats.avgdl or 0.0, 1.0)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, best = sent.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                b = batch.slice(start, BLOCK)
                n = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
                term, tf = (b.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
                doc = np.repeat(np.arange(len(n)), n)
                length = b.column("dl").to_numpy()[doc]
                weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
                score_block(questions.asked, best, k, b.column("doc_id").to_numpy(), doc, term, weight)
        for q, own in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([questions.items[q]] * len(own.docs), pa.int64()), pa.array(own.docs), pa.array(own.scores)], ["item_id", "doc_id", "score"])

    return postings.mapInArrow(score, "item_id long, doc_id long, score double")


def bm25_best(questions: DataFrame, docs: DataFrame, k: int, repeat_query_terms: bool = True) -> DataFrame:
    """item_id, doc_id, score: of each question (item_id, text) at least its k best documents (doc_id, text) and what ties with the last of them.

    Repeated query terms count as often as they occur, or once. Each row of docs is a document. Questions that
    have no term of any document have no rows; null texts have no terms.
    """
    asked = questions.select(F.col("item_id").cast("long").alias("item_id"), F.explode(words(F.col("text"), True)).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("tf"))
    asked = written(asked, "ranking-questions")
    blocks = max(1, -(-asked.count() // SENT))
    parts = [asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == j) for j in range(blocks)]
    return reduce(DataFrame.unionByName, [_best(p, docs, k, not repeat_query_terms) for p in parts])
