"""Retrieval in batches: keyword scores, vector similarity, eligibility, rank fusion and assembly of results.

A query set is a table; all its questions are answered in one plan. Top-k are windows with a rank
limit for each question, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import words
from sparkwell.operators.ranking import bm25_best
from sparkwell.plans.views import oracle, view

RRF = 60
#: Candidates of each channel, and how many of them count after the eligibility filter.
OVERFETCH, LIVE = 180, 60
SERVABLE = ("approved", "extracted", "machine_verified")
# Words about the past, and words of the domain of the questions.
DOMAIN = r"(?i)\b(institute|college|campus|universit[a-zäéà]*)\b"
PAST = r"(?i)\b(historical|previous|past|history|old)\b"


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf of each text's content words."""
    return df.select(key, F.explode(words(F.col(text), True)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _blocks(df: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """ids and the vectors one after the other, of up to size rows of a partition in each row."""
    block = F.floor(F.monotonically_increasing_id() / size)
    rows = df.where(F.col(vector).isNotNull()).select(block.alias("_b"), F.struct(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).alias("x"))
    return rows.groupBy("_b").agg(F.collect_list("x").alias("x")).select(F.col("x.k").alias(f"{key}s"), F.flatten("x.v").alias(f"{vector}s"))


def dense(queries: DataFrame, vectors: DataFrame, k: int | None = None, least: float | None = None, size: int = 1024) -> DataFrame:
    """item_id, doc_id, score: a stated query set (item_id, q) against all vectors (doc_id, v), by inner product.

    Blocks of queries meet blocks of vectors, each pair as one matrix product. Of a block only what may
    be among a query's best k (all that tie with the k-th too), or reaches least, leaves the worker.
    """

    def product(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k_ in range(b.num_rows):
                items, docs, qs, vs = (b.column(c)[k_].values.to_numpy() for c in ("item_ids", "doc_ids", "qs", "vs"))
                if not len(items) or not len(docs):
                    continue
                score = (qs.reshape(len(items), -1) @ vs.reshape(len(docs), -1).T).round(9)
                floor = np.partition(score, -k, axis=1)[:, -k, None] if k and k < len(docs) else -np.inf
                i, j = np.nonzero((score >= floor) & (score >= (-np.inf if least is None else least)))
                yield pa.RecordBatch.from_arrays([pa.array(items[i], pa.int64()), pa.array(docs[j], pa.int64()), pa.array(score[i, j])], ["item_id", "doc_id", "score"])

    pairs = _blocks(vectors, "doc_id", "v", size).crossJoin(_blocks(queries, "item_id", "q", size))
    return pairs.mapInArrow(product, "item_id long, doc_id long, score double")


def without_domain_words(text: Column, pattern: str = DOMAIN) -> Column:
    """A question without the words that stand in nearly every document of its domain and say nothing to the keyword channel."""
    return F.regexp_replace(text, pattern, " ")


def top(scores: DataFrame, k: int, by: str = "item_id", item: str = "doc_id") -> DataFrame:
    w = W.partitionBy(by).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def eligible(blocks: DataFrame, question: Column, year: Column) -> DataFrame:
    """Servable, of the year asked for (undated blocks pass), and not historical unless the question says so."""
    dated = year.isNull() | F.col("year").isNull() | (F.col("year") == year)
    past = F.col("historical") & year.isNull() & ~question.rlike(PAST)
    return blocks.where(F.col("status").isin(*SERVABLE) & dated & ~past)


def fuse(channels: DataFrame, weights: dict[str, float], boost: Column) -> DataFrame:
    """item_id, parent, score by weighted reciprocal ranks; channels has channel, item_id, parent, rank. A parent counts once for each channel, by its best unit."""
    weight = F.coalesce(*(F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()))
    best = channels.groupBy("item_id", "channel", "parent").agg(F.min("rank").alias("rank"), F.max(boost).alias("boost"))
    return best.groupBy("item_id", "parent").agg(F.sum(weight * F.col("boost") / (RRF + F.col("rank"))).alias("score"))


def token_windows(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, text: windows of words, each repeating the last words of the one before."""
    step = size - overlap
    w = F.split(F.trim("text"), r"\s+")
    n = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step) - 1).cast("int")
    cut = df.select("doc_id", w.alias("w")).select("doc_id", "w", F.explode(F.sequence(F.lit(0), n)).alias("chunk"))
    return cut.select("doc_id", "chunk", F.array_join(F.slice("w", F.col("chunk") * step + 1, size), " ").alias("text"))


def ret01_postings(spark, sf_dir):
    t = terms(view(spark, sf_dir, "documents"), "doc_id", "text")
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def ret02_bm25(spark, sf_dir):
    found = bm25_best(view(spark, sf_dir, "benchmark"), view(spark, sf_dir, "documents"), 10)
    return top(found.withColumn("score", F.round("score", 6)), 10)


def ret02_bm25_set(spark, sf_dir):
    found = bm25_best(view(spark, sf_dir, "benchmark"), view(spark, sf_dir, "documents"), 10, repeat_query_terms=False)
    return top(found.withColumn("score", F.round("score", 6)), 10)


def ret03_dense(spark, sf_dir):
    v = view(spark, sf_dir, "vectors")
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    return top(dense(queries, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), 10), 10).withColumn("score", F.round("score", 6))


def flt02_eligibility(spark, sf_dir):
    blocks = view(spark, sf_dir, "blocks")
    return eligible(blocks, F.lit("fees of last term"), F.lit(None).cast("int")).unionByName(eligible(blocks, F.lit("history of fees"), F.lit(2018))).groupBy("status", "year", "historical").agg(F.count("*").alias("n"))


def flt01_servable(spark, sf_dir):
    return view(spark, sf_dir, "blocks").where(F.col("status").isin(*SERVABLE)).groupBy("category", "status").agg(F.count("*").alias("n"))


def flt03_eligibility_legacy(spark, sf_dir):
    """Blocks without a status pass, machine-verified ones don't."""
    b = view(spark, sf_dir, "blocks").withColumn("status", F.nullif("status", F.lit("visual_only")))
    keep = (F.col("status").isNull() | F.col("status").isin("approved", "extracted")) & ~F.col("historical")
    return b.where(keep).groupBy(F.coalesce("status", F.lit("-")).alias("status")).agg(F.count("*").alias("n"))


def flt07_soft_preference(spark, sf_dir):
    score = F.round(1 / (RRF + F.col("page_start")) * F.when(F.col("category") == "de", 1.1).otherwise(1.0), 8)
    return view(spark, sf_dir, "blocks").groupBy("category", score.alias("score")).agg(F.count("*").alias("n"))


def flt20_dated_preference(spark, sf_dir):
    """Of a source's blocks only those of the year stay, if it has any."""
    any_ = F.max((F.col("year") == 2018).cast("int")).over(W.partitionBy("source_id", "category"))
    b = view(spark, sf_dir, "blocks").withColumn("any", F.coalesce(any_, F.lit(0)))
    return b.where((F.col("any") == 0) | (F.col("year") == 2018)).groupBy("source_id", "category").agg(F.count("*").alias("n"), F.min("block_id").alias("first"))


def prj03_embed_text(spark, sf_dir):
    text = F.concat_ws("\n", F.nullif("category", F.lit("en")), F.nullif("source_id", F.lit("src0")), "text")
    return view(spark, sf_dir, "blocks").select("block_id", F.sha2(text, 256).alias("sha"))


def prj04_parent_expansion(spark, sf_dir):
    text = F.when(F.length("text") <= 3500, F.concat_ws(" | ", "source_id", F.col("year").cast("string"), "text")).otherwise(F.col("text"))
    return view(spark, sf_dir, "blocks").select("block_id", F.length(text).alias("n"))


def jn12_related(spark, sf_dir):
    """One hop from the first blocks of each source to others of the same year that aren't among them."""
    b = view(spark, sf_dir, "blocks").where("year is not null")
    w = W.partitionBy("source_id").orderBy("block_id")
    seeds = b.withColumn("r", F.row_number().over(w)).where("r <= 2")
    hop = seeds.select("source_id", "year").distinct().join(b, ["source_id", "year"]).join(seeds.select("block_id"), "block_id", "left_anti")
    return hop.withColumn("r", F.row_number().over(w)).where("r <= 4").select("source_id", "block_id", "r")


def agg09_weakest(spark, sf_dir):
    order = {"approved": 4, "extracted": 3, "machine_verified": 2, "needs_review": 1, "visual_only": 0, "rejected": -1}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    b = view(spark, sf_dir, "blocks")
    return b.groupBy("source_id", "category").agg(F.min_by("status", F.coalesce(rank[F.col("status")], F.lit(0))).alias("weakest"), F.min("page_start").alias("from_page"), F.max("page_end").alias("to_page"))


def agg03_status_histogram(spark, sf_dir):
    return view(spark, sf_dir, "blocks").groupBy("status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def agg27_document_frequency(spark, sf_dir):
    d = view(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    return d.groupBy("lang", "term").agg(F.count("*").alias("df"))


def agg28_average_length(spark, sf_dir):
    return view(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.avg(F.size(words(F.col("text"), True))), 6).alias("avgdl"))


def agg11_sorted_sets(spark, sf_dir):
    return view(spark, sf_dir, "blocks").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"))


def agg12_dominant(spark, sf_dir):
    n = view(spark, sf_dir, "blocks").groupBy("source_id", "category").agg(F.count("*").alias("n"))
    return n.groupBy("source_id").agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"), F.max("n").alias("n"))


def ret16_token_windows(spark, sf_dir):
    return token_windows(view(spark, sf_dir, "documents"), 120, 20).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.size(F.split("text", " "))).alias("longest"))


def ret17_units(spark, sf_dir):
    """Units of three grains: whole pages, sections (lines) and rows of cells."""
    d = view(spark, sf_dir, "documents")
    line = d.select("doc_id", F.explode(F.split("text", "\n")).alias("t"))
    page = d.select("doc_id", F.lit("page").alias("grain"), F.length("text").alias("n"))
    section = line.where(~F.contains("t", F.lit("|"))).select("doc_id", F.lit("section").alias("grain"), F.length("t").alias("n"))
    row = line.where(F.contains("t", F.lit("|"))).select("doc_id", F.lit("row").alias("grain"), F.length("t").alias("n"))
    return page.unionByName(section).unionByName(row).groupBy("doc_id", "grain").agg(F.count("*").alias("units"), F.sum("n").alias("chars"))


def _question_set(spark, sf_dir) -> DataFrame:
    """Documents that have a vector and whose id is divisible by 50: their first words are the question."""
    d = view(spark, sf_dir, "documents").where("doc_id % 50 = 0")
    v = view(spark, sf_dir, "vectors")
    return d.join(v, d["doc_id"] == v["vec_id"]).select(F.col("doc_id").alias("item_id"), F.col("lang").alias("asked"), F.array_join(F.slice(F.split("text", r"\s+"), 1, 12), " ").alias("text"), F.col("embedding").alias("q"))


def ret_hybrid_search(spark, sf_dir):
    """Both channels, over-fetched; live units only; fused by reciprocal rank with a boost for the asked language; six parents for each question."""
    questions, docs, v = _question_set(spark, sf_dir), view(spark, sf_dir, "documents"), view(spark, sf_dir, "vectors")
    near = dense(questions.select("item_id", "q"), v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), OVERFETCH)
    words_ = bm25_best(questions.select("item_id", without_domain_words(F.col("text")).alias("text")), docs.select("doc_id", "text"), OVERFETCH).withColumn("score", F.round("score", 6))
    both = top(near, OVERFETCH).withColumn("channel", F.lit("dense")).unionByName(top(words_, OVERFETCH).withColumn("channel", F.lit("sparse")))
    live = eligible(view(spark, sf_dir, "blocks"), F.lit("question"), F.lit(None).cast("int")).select(F.col("block_id").alias("doc_id"), "category")
    w = W.partitionBy("item_id", "channel").orderBy("rank")
    ranked = both.join(live, "doc_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LIVE)
    asked = ranked.join(questions.select("item_id", "asked"), "item_id").withColumn("parent", F.floor(F.col("doc_id") / 3))
    fused = fuse(asked, {"dense": 1.0, "sparse": 0.8}, F.when(F.col("category") == F.col("asked"), 1.1).otherwise(1.0))
    return top(fused.withColumn("score", F.round("score", 8)), 6, item="parent").select("item_id", "parent", "rank", F.round("score", 6).alias("score"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("ret", "flt", "prj", "jn1", "agg") and callable(f)}

_CW = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9À-ɏ]+|[ऀ-ॿ]+'), lambda w: length(w) > 1 and w not in ('the','a','an','of','and','to','in','is','for','on','with','by'))"


def _bm25(questions: str, times: str) -> str:
    return f"""q as (select item_id, term, count(*) as qtf from (select item_id, unnest({_CW.format('text')}) as term from {questions}) group by all),
    d as (select doc_id, {_CW.format('text')} as w from documents), st as (select count(*) as n, avg(len(w)) as avgdl from d),
    p as (select term, doc_id, dl, count(*) as tf from (select doc_id, len(w) as dl, unnest(w) as term from d) where term in (select term from q) group by all),
    f as (select term, count(*) as df from p group by all),
    s as (select item_id, doc_id, round(sum({times} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 6) as score from p join f using (term) join q using (term), st group by all)"""


_TOP = "select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s) where rank <= 10"
_ELIGIBLE = "status in ('approved','extracted','machine_verified')"

SQL = {
    "ret01_postings": f"select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_CW.format('text')}) as term from documents) group by all) group by all",
    "ret02_bm25": f"with {_bm25('benchmark', 'qtf')} {_TOP}",
    "ret02_bm25_set": f"with {_bm25('benchmark', '1')} {_TOP}",
    "ret03_dense": "select item_id, doc_id, round(score, 6) as score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from (select a.vec_id as item_id, b.vec_id as doc_id, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as score from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 10",
    "flt02_eligibility": oracle(f"select status, year, historical, count(*) as n from (select * from blocks where {_ELIGIBLE} and not historical union all select * from blocks where {_ELIGIBLE} and (year is null or year = 2018)) group by all", "blocks"),
    "flt01_servable": oracle(f"select category, status, count(*) as n from blocks where {_ELIGIBLE} group by all", "blocks"),
    "flt03_eligibility_legacy": oracle("select coalesce(nullif(status, 'visual_only'), '-') as status, count(*) as n from blocks where status in ('approved', 'extracted', 'visual_only') and not historical group by all", "blocks"),
    "flt07_soft_preference": oracle("select category, round(1 / (60 + page_start) * case when category = 'de' then 1.1 else 1.0 end, 8) as score, count(*) as n from blocks group by all", "blocks"),
    "flt20_dated_preference": oracle("select source_id, category, count(*) as n, min(block_id) as first from (select *, coalesce(max(case when year = 2018 then 1 when year is not null then 0 end) over (partition by source_id, category), 0) as a from blocks) where a = 0 or year = 2018 group by all", "blocks"),
    "prj03_embed_text": oracle("select block_id, sha256(concat_ws(chr(10), nullif(category, 'en'), nullif(source_id, 'src0'), text)) as sha from blocks", "blocks"),
    "prj04_parent_expansion": oracle("select block_id, length(case when length(text) <= 3500 then concat_ws(' | ', source_id, cast(year as varchar), text) else text end) as n from blocks", "blocks"),
    "jn12_related": oracle("select source_id, block_id, r from (select b.source_id, b.block_id, row_number() over (partition by b.source_id order by b.block_id) as r from blocks b where b.year is not null and (b.source_id, b.year) in (select (source_id, year) from s where r <= 2) and b.block_id not in (select block_id from s where r <= 2)) where r <= 4", "blocks").replace("select source_id, block_id, r from (select b.", ", s as (select *, row_number() over (partition by source_id order by block_id) as r from blocks where year is not null) select source_id, block_id, r from (select b.", 1),
    "agg09_weakest": oracle("select source_id, category, arg_min(status, case status when 'approved' then 4 when 'extracted' then 3 when 'machine_verified' then 2 when 'needs_review' then 1 when 'rejected' then -1 else 0 end) as weakest, min(page_start) as from_page, max(page_end) as to_page from blocks group by all", "blocks"),
    "agg03_status_histogram": oracle("select status, count(*) as n, cast(sum(n_chars) as bigint) as chars from blocks group by all", "blocks"),
    "agg27_document_frequency": "select lang, term, count(*) as df from (select lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9À-ɏ]+|[ऀ-ॿ]+'))) as term from documents) group by all",
    "agg28_average_length": f"select lang, round(avg(len({_CW.format('text')})), 6) as avgdl from documents group by all",
    "agg11_sorted_sets": oracle("select source_id, array_to_string(list_sort(list_filter(list(distinct year), lambda x: x is not null)), ',') as years, array_to_string(list_sort(list(distinct status)), ',') as statuses from blocks group by all", "blocks"),
    "agg12_dominant": oracle("select source_id, category, n from (select source_id, category, count(*) as n from blocks group by all) qualify row_number() over (partition by source_id order by n desc, category) = 1", "blocks"),
    "ret16_token_windows": "select doc_id, count(*) as chunks, max(least(120, n - k * 100)) as longest from (select doc_id, n, unnest(range(0, cast(greatest(0, ceil((n - 20) / 100) - 1) as int) + 1)) as k from (select doc_id, len(string_split_regex(trim(text, ' '), '\\s+')) as n from documents)) group by all",
    "ret17_units": "select doc_id, grain, count(*) as units, cast(sum(n) as bigint) as chars from (select doc_id, 'page' as grain, length(text) as n from documents union all select doc_id, case when contains(t, '|') then 'row' else 'section' end, length(t) from (select doc_id, unnest(string_split(text, chr(10))) as t from documents)) group by all",
    "ret_hybrid_search": oracle(f"""qs as (select doc_id as item_id, lang as asked, regexp_replace(array_to_string(string_split_regex(text, '\\s+')[1:12], ' '), '(?i)\\b(institute|college|campus|universit[a-zäéà]*)\\b', ' ', 'g') as text, embedding as q from documents join embeddings on vec_id = doc_id where doc_id % 50 = 0), {_bm25('qs', 'qtf')},
    dn as (select item_id, vec_id as doc_id, round(list_inner_product(cast(q as double[]), cast(embedding as double[])), 9) as score from qs, embeddings),
    c as (select item_id, doc_id, 'dense' as channel, score from dn qualify row_number() over (partition by item_id order by score desc, doc_id) <= 180 union all select item_id, doc_id, 'sparse', score from s qualify row_number() over (partition by item_id order by score desc, doc_id) <= 180),
    l as (select c.*, category, row_number() over (partition by item_id, channel order by score desc, doc_id) as rank from c join blocks on block_id = doc_id where {_ELIGIBLE} and not historical),
    b as (select item_id, channel, doc_id // 3 as parent, min(rank) as rank, max(case when category = asked then 1.1 else 1.0 end) as boost from l join qs using (item_id) where rank <= 60 group by all),
    f2 as (select item_id, parent, round(sum(case channel when 'dense' then 1.0 else 0.8 end * boost / (60 + rank)), 8) as score from b group by all)
    select item_id, parent, rank, round(score, 6) as score from (select *, row_number() over (partition by item_id order by score desc, parent) as rank from f2) where rank <= 6""", "blocks").replace(") qs as (", "), qs as (", 1),
}
