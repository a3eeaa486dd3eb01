"""Filters and projections on whole tables, and small checks of tables, quotes and data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import normalized_message, redact_pii, squash
from sparkwell.operators.more import cells_of
from sparkwell.operators.records import validated
from sparkwell.operators.retrieval import LIVE, OVERFETCH, dense, top
from sparkwell.operators.statistics import quantiles
from sparkwell.plans.views import oracle, view
from sparkwell.sources.corpus import lines_of


def requested_year(question: Column, now: Column) -> Column:
    """The year a question names, or the present one for 'this year'; null if none."""
    named = F.regexp_extract(question, r"\b(20[0-4]\d)\b", 1)
    return F.when(named != "", named.cast("int")).when(F.lower(question).rlike("this year|इस साल"), F.year(now))


def quote_holds(quote: Column, text: Column) -> Column:
    """The quote stands in the text, but for case and white space."""
    form = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.contains(form(text), form(quote))


def dense_grid(cells: DataFrame, key: str) -> DataFrame:
    """key, row, col, text for every place of a table with spans; of cells that overlap the first wins."""
    places = cells.select(key, F.explode(F.sequence("row", F.col("row") + F.col("row_span") - 1)).alias("r"), "col", "col_span", "text", "row")
    places = places.select(key, "r", F.explode(F.sequence("col", F.col("col") + F.col("col_span") - 1)).alias("c"), "text", F.struct("row", "col").alias("at"))
    return places.groupBy(key, F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min_by("text", "at").alias("text"))


def _docs(spark, sf_dir):
    return view(spark, sf_dir, "documents")


def flt04_requested_years(spark, sf_dir):
    """Years that all messages ask for; every fifth asks for the present one."""
    asked = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("fees this year: "), F.col("text"))).otherwise(F.concat("text", F.lit(" since "), (1990 + F.col("conv_id") % 80).cast("string")))
    return view(spark, sf_dir, "messages").select("conv_id", "turn", F.coalesce(requested_year(asked, F.lit("2024-05-01").cast("date")), F.lit(-1)).alias("year"))


def flt06_undated_pass(spark, sf_dir):
    return view(spark, sf_dir, "blocks").where("year is null or year in (2016, 2019)").groupBy("year").agg(F.count("*").alias("n"))


def flt11_source_search(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.contains(F.lower(F.concat_ws(" ", "source", "lang")), F.lit("1 d"))).groupBy("source", "lang").agg(F.count("*").alias("n"))


def flt14_preflight(spark, sf_dir):
    reason = F.when(F.length("text") > 2000, "size").when(F.col("turn") > 4, "history").when(F.lower("text").rlike(r"\b(book|cancel|send)\b"), "action").when(F.col("text").rlike("[à-ÿ]"), "not english").otherwise("ok")
    return view(spark, sf_dir, "messages").groupBy("role", reason.alias("reason")).agg(F.count("*").alias("n"))


def flt15_low_information(spark, sf_dir):
    return lines_of(_docs(spark, sf_dir)).where(F.length(F.trim("line")) > 12).groupBy("doc_id").agg(F.count("*").alias("lines"))


def flt16_distance_cutoff(spark, sf_dir):
    v = view(spark, sf_dir, "vectors")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    near = dense(q, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), least=0.29)
    return near.where(1 - F.col("score") <= 0.7).groupBy("item_id").agg(F.count("*").alias("n"))


def flt17_reserved_families(spark, sf_dir):
    """Families of which one member is reserved are left out whole."""
    t = view(spark, sf_dir, "turns")
    reserved = t.where("seconds > 250").select("session_id").distinct()
    return t.join(reserved, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


def flt18_due(spark, sf_dir):
    return view(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate <= timestamp_ntz '1995-06-01'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_custkey")


def prj01_blocks(spark, sf_dir):
    b = view(spark, sf_dir, "blocks")
    return b.select("block_id", F.col("source_id").alias("source_file"), F.concat_ws(" ", "category", F.col("year").cast("string")).alias("title"), F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")).alias("pages"), "historical", F.col("status").alias("verification_status"))


def prj02_hits(spark, sf_dir):
    return view(spark, sf_dir, "blocks").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("year").cast("string"))), ",").alias("years"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


def prj07_without_identity(spark, sf_dir):
    return view(spark, sf_dir, "customer").drop("c_name", "c_acctbal").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


def prj09_turn_labels(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("view", "Viewing", "click", "Choosing", "error", "Failed", "purchase", "Buying")))
    done = F.col("status").isin("purchase", "error")
    return view(spark, sf_dir, "turns").groupBy(F.coalesce(names[F.col("status")], F.lit("Other")).alias("label"), done.alias("terminal")).agg(F.count("*").alias("n"))


def srt03_dense_top(spark, sf_dir):
    v = view(spark, sf_dir, "vectors")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("q"))
    return top(dense(q, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), OVERFETCH), OVERFETCH)


def srt07_by_size(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).orderBy(F.desc("n"), "first").limit(20)


def txt05_legacy_tokens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("tokens"))


def txt16_quotes(spark, sf_dir):
    """Whether a message holds the one before it word for word; every third conversation repeats it with other white space."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumn("before", F.lag("text").over(w)).where("before is not null")
    said = F.concat_ws(" ", "text", F.when(F.col("conv_id") % 3 == 0, F.regexp_replace("before", " ", "  ")))
    return m.select("conv_id", "turn", quote_holds(F.col("before"), said).alias("holds"))


def txt30_spans(spark, sf_dir):
    """Ranges of a text as exact substrings; a range past the end gives none."""
    start, end = (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 50 + 200).cast("int")
    span = F.when(end <= F.length("text"), F.substring("text", start + 1, end - start))
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(F.sha1(span), F.lit("-")).alias("span"))


def arr01_grid(spark, sf_dir):
    """The cells of all documents' tables as a grid; a cell's length says how many rows and columns it spans."""
    c = cells_of(lines_of(_docs(spark, sf_dir)))
    spans = {"row_span": (1 + F.length("cell") % 2).cast("int"), "col_span": (1 + F.length("cell") % 3).cast("int")}
    return dense_grid(c.withColumns(spans).withColumnsRenamed({"pos": "row", "cell": "text"}), "doc_id")


def arr04_keyed_cells(spark, sf_dir):
    """Cells keyed by the first cell of their row."""
    c = cells_of(lines_of(_docs(spark, sf_dir)))
    first = c.where("col = 0").select("doc_id", "pos", F.col("cell").alias("row_key"))
    keyed = c.where("col > 0 and cell <> ''").join(first, ["doc_id", "pos"]).where("row_key <> ''")
    return keyed.groupBy("doc_id").agg(F.count("*").alias("cells"), F.countDistinct("row_key").alias("row_keys"))


def jsn02_canonical(spark, sf_dir):
    p = view(spark, sf_dir, "part")
    return p.select("p_partkey", F.sha2(F.to_json(F.struct("p_brand", "p_name", "p_size")), 256).alias("sha"))


def fct03_build_records(spark, sf_dir):
    """Valid records, one for each evidence and kind, and the log of those rejected."""
    r = validated(view(spark, sf_dir, "records"))
    best = W.partitionBy("evidence_id", "kind").orderBy("record_id", "amount")
    good = r.where("reject_reason is null").withColumn("n", F.row_number().over(best)).where("n = 1").groupBy("kind").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("kept"))
    bad = r.where("reject_reason is not null").groupBy("kind", F.col("reject_reason").alias("outcome")).agg(F.count("*").alias("n"))
    return good.unionByName(bad)


def evl11_gates(spark, sf_dir):
    t = view(spark, sf_dir, "turns")
    p50 = quantiles(t, ["model_calls"], "seconds", {"p50": 0.5}).drop("n")
    good = t.groupBy("model_calls").agg(F.avg((F.col("status") != "error").cast("double")).alias("good"))
    return good.join(p50, "model_calls").select("model_calls", ((F.col("p50") <= 40) & (F.col("good") >= 0.75)).alias("passed"))


def evl20_mining(spark, sf_dir):
    """Answered questions, redacted, each normalized question once."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumn("q", F.lag("text").over(w)).where("role = 'assistant' and q is not null")
    once = m.withColumn("key", F.sha1(normalized_message(redact_pii(F.col("q")))))
    return once.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


def evl27_numbers(spark, sf_dir):
    """Share of messages that hold every number of the message before them, by role, of those that had numbers to hold."""
    w = W.partitionBy("conv_id").orderBy("turn")
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    given = F.concat_ws(" ", F.lag("text").over(w), F.when(F.col("turn") > 0, F.col("turn").cast("string")))
    m = view(spark, sf_dir, "messages").withColumn("given", given).select("role", numbers(F.col("given")).alias("want"), numbers(F.concat_ws(" ", "text", F.when(F.col("conv_id") % 2 == 0, F.col("given")))).alias("have"))
    return m.groupBy("role").agg(F.round(F.avg(F.when(F.size("want") > 0, (F.size(F.array_except("want", "have")) == 0).cast("double"))), 6).alias("accuracy"), F.count_if(F.size("want") > 0).alias("with_numbers"))


def evl31_transcripts(spark, sf_dir):
    m = view(spark, sf_dir, "messages").where("role = 'assistant'")
    return m.groupBy("conv_id").agg(F.round(F.avg(F.col("text").rlike(r"\d|%|₹").cast("double")), 6).alias("leak_rate"))


def dst09_variants(spark, sf_dir):
    v = F.trim(F.regexp_replace("p_name", r"\b(small|red|large)\b", ""))
    return view(spark, sf_dir, "part").withColumn("variant", v).where("variant <> p_name and variant <> ''").groupBy("variant").agg(F.count("*").alias("n"))


def dst11_delimited(spark, sf_dir):
    """Lines of seven fields at most, the rest in the last."""
    f = F.split("line", r" \| ", 7)
    rows = lines_of(_docs(spark, sf_dir)).where(F.contains("line", F.lit(" | ")))
    return rows.groupBy(F.size(f).alias("fields")).agg(F.count("*").alias("n"))


def ret11_routes(spark, sf_dir):
    """The first route that answers: exact rank, records, else search."""
    q = view(spark, sf_dir, "benchmark").withColumn("n", F.length("text"))
    route = F.when(F.col("text").rlike("thon "), "policy").when(F.col("n") > 400, "rank").when(F.col("n") > 200, "records").otherwise("hybrid")
    return q.select("item_id", route.alias("route"))


def win18_fusion_ranks(spark, sf_dir):
    b = view(spark, sf_dir, "blocks").select(F.col("category").alias("item_id"), F.col("block_id").alias("doc_id"), F.col("n_chars").cast("double").alias("score"))
    return top(b, LIVE).select("item_id", "doc_id", "rank")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and "_" in n and len(n.split("_")[0]) in (4, 5) and n.split("_")[0][-2:].isdigit()}

_L = "(select doc_id, unnest(range(len(p))) as pos, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents))"
_C = f"(select doc_id, pos, unnest(range(len(c))) as col, trim(unnest(c), ' ') as cell from (select doc_id, pos, string_split(line, '|') as c from {_L} where contains(line, '|')))"
_SQ = "lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '[|`]', ' ', 'g'), '(\\d),\\s*(\\d)', '\\1\\2', 'g'), '\\s+', ' ', 'g')))"
_T = lambda body: oracle(body, "turns")
_B = lambda body: oracle(body, "blocks")
_REJ = "case when kind='cutoff' and coalesce(closing_rank,'')='' then 'missing closing_rank' when kind='cutoff' and cast(rtrim(opening_rank,'P') as double) > cast(rtrim(closing_rank,'P') as double) then 'opening after closing' when kind='fee' and coalesce(amount,0) <= 0 then 'bad amount' end"
_FORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' '))"
_RED = "regexp_replace(regexp_replace(regexp_replace({0}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), '\\+[0-9]{{1,3}}[ ()0-9-]{{7,16}}[0-9]', '[PHONE]', 'g'), '[0-9]{{12,}}', '[ID]', 'g')"

SQL = {
    "flt04_requested_years": "select conv_id, turn, case when y <> '' then cast(y as int) when contains(lower(q), 'this year') then 2024 else -1 end as year from (select conv_id, turn, q, regexp_extract(q, '\\b(20[0-4]\\d)\\b', 1) as y from (select conv_id, turn, case when turn % 5 = 4 then 'fees this year: ' || text else text || ' since ' || (1990 + conv_id % 80) end as q from conversations))",
    "flt06_undated_pass": _B("select year, count(*) as n from blocks where year is null or year in (2016, 2019) group by all"),
    "flt11_source_search": "select source, lang, count(*) as n from documents where contains(lower(source || ' ' || lang), '1 d') group by all",
    "flt14_preflight": "select role, case when length(text) > 2000 then 'size' when turn > 4 then 'history' when regexp_matches(lower(text), '\\b(book|cancel|send)\\b') then 'action' when regexp_matches(text, '[à-ÿ]') then 'not english' else 'ok' end as reason, count(*) as n from conversations group by all",
    "flt15_low_information": f"select doc_id, count(*) as lines from {_L} where length(trim(line, ' ')) > 12 group by all",
    "flt16_distance_cutoff": "select a.vec_id as item_id, count(*) as n from embeddings a, embeddings b where a.vec_id % 50 = 0 and 1 - round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) <= 0.7 group by all",
    "flt17_reserved_families": _T("select session_id, count(*) as n from turns where session_id not in (select session_id from turns where seconds > 250) group by all"),
    "flt18_due": "select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_orderdate <= timestamp '1995-06-01' order by o_orderdate, o_orderkey limit 100",
    "prj01_blocks": _B("select block_id, source_id as source_file, concat_ws(' ', category, cast(year as varchar)) as title, page_start || '-' || page_end as pages, historical, status as verification_status from blocks"),
    "prj02_hits": _B("select source_id, coalesce(string_agg(distinct cast(year as varchar), ',' order by cast(year as varchar)), '') as years, string_agg(distinct category, ',' order by category) as categories from blocks group by all"),
    "prj07_without_identity": "select c_nationkey, c_mktsegment, count(*) as n from customer group by all",
    "prj09_turn_labels": _T("select case status when 'view' then 'Viewing' when 'click' then 'Choosing' when 'error' then 'Failed' when 'purchase' then 'Buying' else 'Other' end as label, status in ('purchase', 'error') as terminal, count(*) as n from turns group by all"),
    "srt03_dense_top": "select item_id, doc_id, score, rank from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from (select a.vec_id as item_id, b.vec_id as doc_id, round(list_inner_product(cast(a.embedding as double[]), cast(b.embedding as double[])), 9) as score from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 180",
    "srt07_by_size": "select source, lang, count(*) as n, min(doc_id) as first from documents group by all order by n desc, first limit 20",
    "txt05_legacy_tokens": "select doc_id, len(regexp_extract_all(text, '[\\pL\\pN_]+')) as tokens from documents",
    "txt16_quotes": f"select conv_id, turn, contains({_FORM.format('s')}, {_FORM.format('b')}) as holds from (select conv_id, turn, b, case when conv_id % 3 = 0 then text || ' ' || replace(b, ' ', '  ') else text end as s from (select *, lag(text) over (partition by conv_id order by turn) as b from conversations) where b is not null)",
    "txt30_spans": "select doc_id, case when doc_id % 50 + 200 <= length(text) then sha1(substr(text, doc_id % 50 + 1, 200)) else '-' end as span from documents",
    "arr01_grid": f"select doc_id, r as row, c as col, arg_min(cell, {{'row': pos, 'col': col}}) as text from (select doc_id, pos, col, cell, r, unnest(range(col, col + 1 + length(cell) % 3)) as c from (select doc_id, pos, col, cell, unnest(range(pos, pos + 1 + length(cell) % 2)) as r from {_C})) group by all",
    "arr04_keyed_cells": f"select doc_id, count(*) as cells, count(distinct k.cell) as row_keys from {_C} c join (select doc_id, pos, cell from {_C} where col = 0 and cell <> '') k using (doc_id, pos) where c.col > 0 and c.cell <> '' group by all",
    "jsn02_canonical": "select p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}') as sha from part",
    "fct03_build_records": oracle(f"select kind, count(distinct evidence_id) as n, 'kept' as outcome from (select *, {_REJ} as r from records) where r is null group by all union all select kind, count(*), r from (select *, {_REJ} as r from records) where r is not null group by kind, r", "records"),
    "evl11_gates": _T("select model_calls, quantile_cont(seconds, 0.5) <= 40 and avg(case when status <> 'error' then 1.0 else 0.0 end) >= 0.75 as passed from turns group by all"),
    "evl20_mining": "select sha1(regexp_replace(regexp_replace(lower(trim(" + _RED.format("q") + ", ' ')), '\\s+', ' ', 'g'), '[ ?.!।]+$', '')) as key, count(*) as n, min(conv_id) as first from (select *, lag(text) over (partition by conv_id order by turn) as q from conversations) where role = 'assistant' and q is not null group by all",
    "evl27_numbers": "select role, round(avg(case when len(w) > 0 then case when len(list_filter(w, lambda x: not list_contains(h, x))) = 0 then 1.0 else 0.0 end end), 6) as accuracy, count(*) filter (where len(w) > 0) as with_numbers from (select role, regexp_extract_all(g, '\\d+') as w, regexp_extract_all(case when conv_id % 2 = 0 then text || ' ' || g else text end, '\\d+') as h from (select *, concat_ws(' ', lag(text) over (partition by conv_id order by turn), case when turn > 0 then cast(turn as varchar) end) as g from conversations)) group by all",
    "evl31_transcripts": "select conv_id, round(avg(case when regexp_matches(text, '\\d|%|₹') then 1.0 else 0.0 end), 6) as leak_rate from conversations where role = 'assistant' group by all",
    "dst09_variants": "select variant, count(*) as n from (select p_name, trim(regexp_replace(p_name, '\\b(small|red|large)\\b', '', 'g'), ' ') as variant from part) where variant <> p_name and variant <> '' group by all",
    "dst11_delimited": f"select least(7, len(string_split(line, ' | '))) as fields, count(*) as n from {_L} where contains(line, ' | ') group by all",
    "ret11_routes": "select item_id, case when contains(text, 'thon ') then 'policy' when length(text) > 400 then 'rank' when length(text) > 200 then 'records' else 'hybrid' end as route from benchmark",
    "win18_fusion_ranks": _B("select category as item_id, block_id as doc_id, row_number() over (partition by category order by n_chars desc, block_id) as rank from blocks qualify row_number() over (partition by category order by n_chars desc, block_id) <= 60"),
}
