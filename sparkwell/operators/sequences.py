"""Operators over ordered rows: headings, running headers, joins across breaks, runs, histories, fuzzy and set checks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.functions.text import words
from sparkwell.plans.views import view
from sparkwell.sources.corpus import line_kind, lines_of


def heading_path(rows: DataFrame, key: str, pos: str, level1: Column, level2: Column, text: str) -> DataFrame:
    """rows with h1 and h2: a heading of level 1 resets the path, one of level 2 replaces its second part."""
    w = W.partitionBy(key).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_at1", F.max(F.when(level1, F.col(pos))).over(w))
    two = F.max(F.when(level2, F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).over(w)
    one = F.max(F.when(level1, F.struct(F.col(pos).alias("p"), F.col(text).alias("t")))).over(w)
    rows = rows.withColumns({"_one": one, "_two": two})
    return rows.withColumns({"h1": F.col("_one.t"), "h2": F.when(F.col("_two.p") > F.coalesce("_at1", F.lit(-1)), F.col("_two.t"))}).drop("_at1", "_one", "_two")


def running_lines(rows: DataFrame, doc: str, page: str, pos: str, line: str, share: float = 0.6, longest: int = 120) -> DataFrame:
    """First and last lines that repeat over the pages of a document of three pages or more: doc, line, side, pages."""
    w = W.partitionBy(doc, page)
    ends = rows.withColumns({"up": F.row_number().over(w.orderBy(pos)), "down": F.row_number().over(w.orderBy(F.desc(pos)))}).where("up = 1 or down = 1")
    n = rows.groupBy(doc).agg(F.countDistinct(page).alias("n")).where("n >= 3")
    sides = ends.withColumn("side", F.explode(F.filter(F.array(F.when(F.col("up") == 1, "head"), F.when(F.col("down") == 1, "foot")), lambda x: x.isNotNull())))
    counts = sides.where(F.length(line) < longest).groupBy(doc, line, "side").agg(F.countDistinct(page).alias("pages"))
    return counts.join(n, doc).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(share * F.col("n")))).drop("n")


def islands(rows: DataFrame, key: str, pos: str, flag: Column, least: int) -> DataFrame:
    """Runs of at least so many consecutive rows with the flag: key, first position, length."""
    rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(pos))).where(flag)
    rows = rows.withColumn("_run", F.col("_rn") - F.row_number().over(W.partitionBy(key).orderBy(pos)))
    return rows.groupBy(key, "_run").agg(F.min(pos).alias("first"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_run")


def recent_pairs(messages: DataFrame, budget: int, most: int) -> DataFrame:
    """The last complete question-answer pairs of each conversation while their lengths fit the budget."""
    w = W.partitionBy("conv_id").orderBy("turn")
    asked = F.lag(F.struct("role", "text")).over(w)
    pairs = messages.withColumn("_q", asked).where((F.col("role") == "assistant") & (F.col("_q.role") == "user"))
    size = F.length("text") + F.length("_q.text")
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    pairs = pairs.withColumns({"rn": F.row_number().over(back), "used": F.sum(size).over(back.rowsBetween(W.unboundedPreceding, 0))})
    return pairs.where((F.col("rn") <= most) & (F.col("used") <= budget)).select("conv_id", "turn", "rn", "used")


def lcs_ratio(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|), by bit-parallel LCS."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return 200.0 * (len(a) - v.bit_count()) / (len(a) + len(b))


def fuzzy_ratio(a: Column | str, b: Column | str) -> Column:
    """lcs_ratio of two columns, in Arrow batches; nulls count as empty."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([lcs_ratio(s or "", t or "") for s, t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


def bigrams(key: Column) -> Column:
    """Pairs of neighbouring characters, repeated ones numbered; a key of one character is its own."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substring(key, i, 2))
    numbered = F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, 1, i), lambda x: x == g)).cast("string")))
    return F.when(F.length(key) >= 2, numbered).otherwise(F.array(F.concat(F.lit("="), key)))


def fuzzy_cells(wanted: DataFrame, cells: DataFrame, least: float = 90.0) -> DataFrame:
    """id, cell_id and exact: for each wanted (id, row_key, col_key) the first cell (cell_id, row_key, col_key) with both keys, else the first whose keys are both alike by least or more.

    Keys of length n that are 90 alike share 0.6 n - 1 of their bigrams or more; so they share one of their
    0.4 n + 1 rarest, by which pairs are found. Scores are taken once for each pair of different keys.
    """
    if least < 90:
        raise ValueError("the bound on shared bigrams holds from 90 on")
    keys = ["row_key", "col_key"]
    first = cells.groupBy(*keys).agg(F.min("cell_id").alias("cell_id"))
    known = wanted.join(first, keys).select("id", "cell_id", F.lit(True).alias("exact"))
    rest = wanted.join(first, keys, "left_anti")
    grams = lambda df: df.select(*keys, *(c for c in df.columns if c == "cell_id"), F.length("row_key").alias("n"), F.explode(bigrams(F.col("row_key"))).alias("gram"))
    left, right = grams(rest.select(*keys).distinct()), grams(first)
    df_ = left.select("gram").union(right.select("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def rarest(g: DataFrame) -> DataFrame:
        own = W.partitionBy(*keys).orderBy("df", "gram")  # the bigrams of one key
        return g.join(df_, "gram").withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= F.floor(0.4 * F.col("n")) + 1)

    a = rarest(left).select("gram", F.col("row_key").alias("ra"), F.col("col_key").alias("ca"))
    b = rarest(right).select("gram", F.col("row_key").alias("rb"), F.col("col_key").alias("cb"), "cell_id")
    close = lambda x, y: F.least(F.length(x), F.length(y)) * 2 * 100 >= least * (F.length(x) + F.length(y))
    pairs = a.join(b, "gram").where(close("ra", "rb") & close("ca", "cb")).drop("gram").distinct()
    alike = pairs.where(fuzzy_ratio("ra", "rb") >= least).where(fuzzy_ratio("ca", "cb") >= least)
    best = alike.groupBy(F.col("ra").alias("row_key"), F.col("ca").alias("col_key")).agg(F.min("cell_id").alias("cell_id"))
    return known.unionByName(rest.join(best, keys).select("id", "cell_id", F.lit(False).alias("exact")))


def within_budget(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows that fit a budget in order; one that doesn't is skipped, later ones may still fit."""
    def fold(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))
        return F.aggregate(parts, start, lambda s, x: F.when(s["used"] + x["_s"] <= budget, F.struct((s["used"] + x["_s"]).alias("used"), F.concat(s["kept"], F.array(x["_o"])).alias("kept"))).otherwise(s))

    parts = F.array_sort(F.collect_list(F.struct(F.col(order).cast("long").alias("_o"), F.col(size).cast("long").alias("_s"))))
    return rows.groupBy(key).agg(fold(parts).alias("s")).select(key, F.explode("s.kept").alias(order), F.col("s.used").alias("used"))


def pack_paragraphs(docs: DataFrame, target: int = 380, whole: float = 1.5) -> DataFrame:
    """doc_id, unit, text: short texts whole, longer ones in units of paragraphs, each beginning with the last paragraph of the one before."""
    def pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                paras = [p for p in (text or "").split("\n") if p.strip()]
                sizes = [len(p.split()) for p in paras]
                if sum(sizes) <= target * whole:
                    out.append((doc_id, 0, "\n".join(paras)))
                    continue
                unit, held, n, fresh = 0, [], 0, False
                for p, s in zip(paras, sizes, strict=True):
                    if fresh and n + s > target:
                        out.append((doc_id, unit, "\n".join(held)))
                        unit, held, fresh = unit + 1, held[-1:], False
                        n = len(held[0].split())
                    held.append(p)
                    n, fresh = n + s, True
                if fresh:
                    out.append((doc_id, unit, "\n".join(held)))
            yield pd.DataFrame(out, columns=["doc_id", "unit", "text"])

    return docs.select("doc_id", "text").mapInPandas(pack, "doc_id long, unit long, text string")


def _lines(spark, sf_dir):
    return lines_of(view(spark, sf_dir, "documents"))


def win01_element_ids(spark, sf_dir):
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = _lines(spark, sf_dir).where("trim(line) <> ''")
    return rows.select("doc_id", "pos", F.format_string("e%04d", F.row_number().over(w)).alias("element"))


def win02_heading_path(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    level = F.length("line")
    path = heading_path(rows, "doc_id", "pos", level < 20, (level >= 20) & (level < 45), "line")
    return path.select("doc_id", "pos", F.sha1(F.concat_ws(" > ", "h1", "h2")).alias("path"))


def win05_running_lines(spark, sf_dir):
    """Documents of a source as its pages."""
    d = view(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return running_lines(d, "source", "doc_id", "pos", "line", share=0.02)


def win06_joined_paragraphs(spark, sf_dir):
    """A line goes on with the next one unless it ends a sentence and the next begins one."""
    w = W.partitionBy("doc_id").orderBy("pos")
    before = F.lag("line").over(w)
    goes_on = ~before.rlike(r"[.!?:]\s*$") & (F.substring("line", 1, 1).rlike("[a-zà-ÿ]") | before.rlike(r"[,(-]\s*$"))
    rows = _lines(spark, sf_dir).withColumn("para", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("doc_id").agg(F.countDistinct("para").alias("paragraphs"), F.count("*").alias("lines"))


def win07_table_merge(spark, sf_dir):
    """Consecutive rows of cells with the same number of cells form one table."""
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = _lines(spark, sf_dir).withColumn("cells", F.size(F.split("line", r"\|"))).where("cells > 1")
    same = (F.lag("cells").over(w) == F.col("cells")) & (F.lag("pos").over(w) == F.col("pos") - 1)
    rows = rows.withColumn("table", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(w))
    return rows.groupBy("doc_id", "table").agg(F.count("*").alias("rows"), F.first("cells").alias("cells"))


def win08_runs(spark, sf_dir):
    return islands(_lines(spark, sf_dir), "doc_id", "pos", F.length("line") < 60, 3)


def win09_pairs(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)
    return view(spark, sf_dir, "messages").withColumn("asked", asked).where("role = 'assistant' and asked is not null").select("conv_id", "turn", "asked")


def win10_history(spark, sf_dir):
    return recent_pairs(view(spark, sf_dir, "messages"), 3000, 4)


def win11_latest(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("role") == "assistant", F.length("text")), ignorenulls=True).over(w)
    return view(spark, sf_dir, "messages").select("conv_id", "turn", F.coalesce(latest, F.lit(0)).alias("latest"))


def win14_first_seen(spark, sf_dir):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return view(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("user_id", "event_type", "event_id")


def win03_break_groups(spark, sf_dir):
    """A new parent at each heading line."""
    w = W.partitionBy("doc_id").orderBy("pos")
    rows = _lines(spark, sf_dir).withColumn("kind", line_kind(F.col("line")))
    rows = rows.withColumn("parent", F.sum(F.col("kind").isin("heading", "heading_like").cast("int")).over(w))
    return rows.groupBy("doc_id", "parent").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


def agg10_ordered_concat(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return view(spark, sf_dir, "messages").groupBy("conv_id").agg(F.sha1(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n")).alias("sha"))


def srt05_relative_gate(spark, sf_dir):
    """Scores near the best of their group, if that is high enough."""
    best = F.max("value").over(W.partitionBy("user_id"))
    return view(spark, sf_dir, "events").withColumn("best", best).where((F.col("best") < 250) | (F.col("value") >= F.col("best") - 25)).groupBy("user_id").agg(F.count("*").alias("n"))


def srt06_stable_rerank(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc(F.col("event_type") == "purchase"), F.desc("value"), "event_id")
    return view(spark, sf_dir, "events").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("user_id", "rank", "event_id")


def srt08_priority_queue(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy(F.desc(F.col("value") < 20), "ts", "event_id")
    return view(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("turn"))


def set04_containment(spark, sf_dir):
    """Answers whose numbers all occur in the question before them."""
    n = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    w = W.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumn("before", F.lag("text").over(w)).where("role = 'assistant'")
    return m.select("conv_id", "turn", (F.size(F.array_except(n(F.col("text")), n(F.coalesce("before", F.lit(""))))) == 0).alias("contained"))


def set05_overlap(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    m = view(spark, sf_dir, "messages").withColumn("before", F.lag("text").over(w)).where("before is not null")
    a, b = (F.array_distinct(words(F.col(c))) for c in ("before", "text"))
    return m.select("conv_id", "turn", F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(b)), F.lit(0.0)), 6).alias("share"))


def jn13_fuzzy_cells(spark, sf_dir):
    """Cells of all parts by name and type; wanted are the same keys, two of three with a letter too few or too many."""
    p = view(spark, sf_dir, "part")
    cells = p.select(F.col("p_partkey").alias("cell_id"), F.col("p_name").alias("row_key"), F.col("p_type").alias("col_key"))
    k, n = F.col("p_partkey"), (F.col("p_partkey") % 5 + 2).cast("int")
    name = F.when(k % 3 == 1, F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))).when(k % 3 == 2, F.concat(F.substring("p_name", F.lit(1), n), F.lit("x"), F.substring("p_name", n + 1, F.lit(99)))).otherwise(F.col("p_name"))
    wanted = p.select(k.alias("id"), name.alias("row_key"), F.when(k % 7 == 0, F.concat("p_type", F.lit("s"))).otherwise(F.col("p_type")).alias("col_key"))
    return fuzzy_cells(wanted, cells)


def fuz01_ratio(spark, sf_dir):
    p = view(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws(" ", "p_type", "p_brand").alias("other"))
    return p.select("p_partkey", F.round(fuzzy_ratio("p_name", "other"), 4).alias("ratio"))


def flt19_budget(spark, sf_dir):
    d = view(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return within_budget(d, "conv_id", "turn", "n", 2000)


def win04_packing(spark, sf_dir):
    units = pack_paragraphs(view(spark, sf_dir, "documents"))
    return units.select("doc_id", "unit", F.length("text").alias("n_chars"), F.sha1("text").alias("sha"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("win", "agg", "srt", "set", "fuz", "flt") and n[3:5].isdigit() and callable(f)} | {"jn13_fuzzy_cells": jn13_fuzzy_cells}

_KIND = "case when trim(line, ' ') = '' then 'blank' when regexp_matches(line, '^#{1,6} ') then 'heading' when regexp_matches(line, '^\\s*([-*]|\\d+\\.) ') then 'x' when contains(line, '|') then 'x' when starts_with(line, '```') then 'x' when length(line) < 60 and not regexp_matches(line, '[.,;:!?]\\s*$') then 'heading_like' else 'x' end"
_L = "select doc_id, unnest(range(len(p))) as pos, unnest(p) as line from (select doc_id, string_split(text, chr(10)) as p from documents)"
_CW = "regexp_extract_all(lower({0}), '[a-z0-9À-ɏ]+|[ऀ-ॿ]+')"

SQL = {
    "flt19_budget": "with recursive q as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn, length(text)) as r from conversations), c(conv_id, turn, r, used, kept) as (select conv_id, turn, r, case when n <= 2000 then n else 0 end, n <= 2000 from q t where r = 1 union all select t.conv_id, t.turn, t.r, c.used + case when c.used + t.n <= 2000 then t.n else 0 end, c.used + t.n <= 2000 from c join q t on t.conv_id = c.conv_id and t.r = c.r + 1) select conv_id, turn, max(used) over (partition by conv_id) as used from c where kept",
    "win01_element_ids": f"select doc_id, pos, 'e' || lpad(cast(row_number() over (partition by doc_id order by pos) as varchar), 4, '0') as element from ({_L}) where trim(line, ' ') <> ''",
    "win02_heading_path": f"select doc_id, pos, sha1(concat_ws(' > ', h1, case when p2 > coalesce(p1, -1) then h2 end)) as path from (select doc_id, pos, last_value(case when length(line) < 20 then line end ignore nulls) over w as h1, max(case when length(line) < 20 then pos end) over w as p1, last_value(case when length(line) between 20 and 44 then line end ignore nulls) over w as h2, max(case when length(line) between 20 and 44 then pos end) over w as p2 from ({_L}) window w as (partition by doc_id order by pos rows unbounded preceding))",
    "win05_running_lines": "with l as (select source, doc_id, unnest(range(len(p))) as pos, unnest(p) as line from (select source, doc_id, string_split(text, chr(10)) as p from documents)), r as (select *, row_number() over (partition by source, doc_id order by pos) as u, row_number() over (partition by source, doc_id order by pos desc) as d from l), s as (select source, doc_id, line, 'head' as side from r where u = 1 union all select source, doc_id, line, 'foot' from r where d = 1), n as (select source, count(distinct doc_id) as n from l group by all) select source, line, side, pages from (select source, line, side, count(distinct doc_id) as pages from s where length(line) < 120 group by all) join n using (source) where n >= 3 and pages >= greatest(2, floor(0.02 * n))",
    "win06_joined_paragraphs": f"select doc_id, count(distinct para) as paragraphs, count(*) as lines from (select doc_id, sum(case when coalesce(not regexp_matches(b, '[.!?:]\\s*$') and (regexp_matches(substr(line, 1, 1), '[a-zà-ÿ]') or regexp_matches(b, '[,(-]\\s*$')), false) then 0 else 1 end) over (partition by doc_id order by pos) as para from (select *, lag(line) over (partition by doc_id order by pos) as b from ({_L}))) group by all",
    "win07_table_merge": f"select doc_id, cast(t as bigint) as \"table\", count(*) as rows, any_value(cells) as cells from (select doc_id, cells, sum(case when coalesce(c0 = cells and p0 = pos - 1, false) then 0 else 1 end) over (partition by doc_id order by pos) as t from (select *, lag(cells) over (partition by doc_id order by pos) as c0, lag(pos) over (partition by doc_id order by pos) as p0 from (select *, len(string_split(line, '|')) as cells from ({_L})) where cells > 1)) group by all",
    "win08_runs": f"select doc_id, min(pos) as first, count(*) as length from (select doc_id, pos, rn - row_number() over (partition by doc_id order by pos) as g from (select *, row_number() over (partition by doc_id order by pos) as rn from ({_L})) where length(line) < 60) group by doc_id, g having count(*) >= 3",
    "win09_pairs": "select conv_id, turn, asked from (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as asked from conversations) where role = 'assistant' and asked is not null",
    "win10_history": "select conv_id, turn, rn, cast(used as bigint) as used from (select conv_id, turn, row_number() over w as rn, sum(n) over w as used from (select conv_id, turn, role, length(text) + length(lag(text) over (partition by conv_id order by turn)) as n, lag(role) over (partition by conv_id order by turn) as r0 from conversations) where role = 'assistant' and r0 = 'user' window w as (partition by conv_id order by turn desc rows unbounded preceding)) where rn <= 4 and used <= 3000",
    "win11_latest": "select conv_id, turn, coalesce(last_value(case when role = 'assistant' then length(text) end ignore nulls) over (partition by conv_id order by turn rows unbounded preceding), 0) as latest from conversations",
    "win14_first_seen": "select user_id, event_type, arg_min(event_id, (ts, event_id)) as event_id from events group by all",
    "win03_break_groups": f"select doc_id, cast(parent as bigint) as parent, count(*) as lines, cast(sum(length(line)) as bigint) as chars from (select doc_id, line, sum(case when {_KIND} in ('heading', 'heading_like') then 1 else 0 end) over (partition by doc_id order by pos) as parent from ({_L})) group by all",
    "agg10_ordered_concat": "select conv_id, sha1(string_agg(text, chr(10) || chr(10) order by turn)) as sha from conversations group by all",
    "srt05_relative_gate": "select user_id, count(*) as n from (select *, max(value) over (partition by user_id) as b from events) where b < 250 or value >= b - 25 group by all",
    "srt06_stable_rerank": "select user_id, rank, event_id from (select *, row_number() over (partition by user_id order by event_type = 'purchase' desc, value desc, event_id) as rank from events) where rank <= 5",
    "srt08_priority_queue": "select user_id, event_id, row_number() over (partition by user_id order by value < 20 desc, ts, event_id) as turn from events",
    "set04_containment": "select conv_id, turn, len(list_filter(regexp_extract_all(text, '\\d+'), lambda x: not list_contains(regexp_extract_all(coalesce(b, ''), '\\d+'), x))) = 0 as contained from (select *, lag(text) over (partition by conv_id order by turn) as b from conversations) where role = 'assistant'",
    "set05_overlap": f"select conv_id, turn, round(coalesce(len(list_intersect(list_distinct({_CW.format('b')}), list_distinct({_CW.format('text')}))) / nullif(len(list_distinct({_CW.format('text')})), 0), 0), 6) as share from (select *, lag(text) over (partition by conv_id order by turn) as b from conversations) where b is not null",
}
