"""Typed facts: validation, exact lookups, facets, joins with their evidence, and their order."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.plans.views import oracle, view

#: Columns that an exact lookup may constrain.
LOOKUP_KEYS = ("kind", "year", "authority", "round", "programme", "quota", "seat_category")
REQUIRED = ("year", "authority", "round", "programme", "quota", "seat_category")
CRITICAL_KINDS = ("fee", "date", "cutoff", "scholarship", "finance")


def rank_value(rank: Column) -> Column:
    """The number of a rank text; a trailing P (preparatory) is not part of it. Other text gives null."""
    return F.when(rank.rlike(r"^\d+(\.\d+)?P?$"), F.regexp_replace(rank, "P$", "").cast("double"))


def validated(records: DataFrame, evidence_ids: DataFrame | None = None) -> DataFrame:
    """records with reject_reason: the first rule that fails, null for valid rows."""
    missing = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing {c}")) for c in REQUIRED]
    rank_rules = [
        F.when((F.col("kind") == "cutoff") & (F.coalesce("closing_rank", F.lit("")) == ""), F.lit("missing closing_rank")),
        F.when((F.col("kind") == "cutoff") & rank_value(F.col("closing_rank")).isNull(), F.lit("bad closing_rank")),
        F.when((F.col("kind") == "cutoff") & (rank_value(F.col("opening_rank")) > rank_value(F.col("closing_rank"))), F.lit("opening after closing")),
    ]
    money = [F.when((F.col("kind") == "fee") & (F.coalesce("amount", F.lit(0)) <= 0), F.lit("bad amount"))]
    return records.withColumn("reject_reason", F.coalesce(*missing, *rank_rules, *money))


def exact_lookup(records: DataFrame, **wanted) -> DataFrame:
    """Rows equal to every given value; None values are skipped, an unknown key is an error."""
    unknown = set(wanted) - set(LOOKUP_KEYS)
    if unknown:
        raise ValueError(f"not a lookup key: {sorted(unknown)}")
    tests = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return records.where(reduce(and_, tests)) if tests else records


def lookup_order() -> list[Column]:
    return [F.desc("year"), F.desc(F.col("round").cast("int")), F.col("programme"), F.col("seat_category"), F.col("quota"), F.col("record_id"), F.col("amount"), F.col("closing_rank")]


def facets(records: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value: the distinct values of each column, in one pass over the rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return records.select(pairs.alias("p")).select("p.*").where("value is not null").distinct()


def review_status(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Critical kinds wait for a decision; others are approved as they come."""
    joined = records.join(decisions, "record_id", "left")
    return joined.withColumn("review_status", F.when(~F.col("kind").isin(*CRITICAL_KINDS), "auto_approved").otherwise(F.coalesce("decision", F.lit("pending"))))


def label(records: DataFrame) -> DataFrame:
    """A readable line for each record, in a fixed order of parts; parts that are missing are left out."""
    parts = [F.col("authority"), F.col("year").cast("string"), F.concat(F.lit("round "), F.col("round")), F.col("programme"), F.col("seat_category"), F.concat(F.lit("closing rank "), F.nullif("closing_rank", F.lit("")))]
    return records.withColumn("label", F.concat_ws(" | ", *parts))


def _records(spark, sf_dir):
    return view(spark, sf_dir, "records")


def flt08_exact_lookup(spark, sf_dir):
    return exact_lookup(_records(spark, sf_dir), kind="cutoff", authority="authority-2", quota="F", year=None).select("record_id", "year", "round", "programme", "closing_rank", "amount")


def flt12_row_validation(spark, sf_dir):
    return validated(_records(spark, sf_dir)).groupBy("kind", F.coalesce("reject_reason", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


def flt13_critical_gate(spark, sf_dir):
    records = _records(spark, sf_dir)
    decisions = view(spark, sf_dir, "evidence").where("status = 'F'").select(F.col("evidence_id").alias("record_id"), F.lit("approved").alias("decision"))
    return review_status(records.withColumn("record_id", F.col("evidence_id")), decisions).groupBy("kind", "review_status").agg(F.count("*").alias("n"))


def flt09_facet_filter(spark, sf_dir):
    return exact_lookup(_records(spark, sf_dir), year=1997, programme=None, seat_category="category-1").groupBy("programme").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def flt10_like_search(spark, sf_dir):
    return label(_records(spark, sf_dir)).where(F.col("label").ilike("%PROGRAMME-7%") | F.col("closing_rank").ilike("%5p%")).groupBy("programme").agg(F.count("*").alias("n"))


def prj05_label(spark, sf_dir):
    return label(_records(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


def prj06_display_value(spark, sf_dir):
    value = F.coalesce(F.when(F.col("kind") == "fee", F.col("amount").cast("string")), F.nullif("closing_rank", F.lit("")), F.nullif("opening_rank", F.lit("1")), F.lit("-"))
    return _records(spark, sf_dir).select("kind", value.alias("value")).groupBy("kind", "value").agg(F.count("*").alias("n"))


def prj08_money(spark, sf_dir):
    paise = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.format_string("₹%,d.%02d", F.expr("cast(round(l_extendedprice * 100) as bigint) div 100"), paise % 100).alias("price"))


def srt01_lookup_order(spark, sf_dir):
    return exact_lookup(_records(spark, sf_dir), kind="cutoff").orderBy(*lookup_order()).limit(50).select("record_id", "year", "round", "programme", "seat_category", "quota", "amount", "closing_rank")


def srt02_facet_page(spark, sf_dir):
    order = [F.desc("year"), F.col("authority"), F.col("programme"), F.col("round").cast("int"), F.col("seat_category"), F.col("record_id"), F.col("amount")]
    return exact_lookup(_records(spark, sf_dir), quota="O").orderBy(*order).limit(40).select("record_id", "year", "authority", "programme", "round", "seat_category", "amount")


def jn02_record_evidence(spark, sf_dir):
    joined = _records(spark, sf_dir).join(view(spark, sf_dir, "evidence").select("evidence_id", F.col("status").alias("evidence_status"), "title"), "evidence_id")
    return joined.groupBy("kind", "evidence_status", "title").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def jn04_override(spark, sf_dir):
    """A reviewed amount replaces the extracted one."""
    reviews = view(spark, sf_dir, "evidence").where("title = '1-URGENT'").select("evidence_id", F.lit(0).cast("bigint").alias("reviewed"))
    return _records(spark, sf_dir).join(reviews, "evidence_id", "left").groupBy("kind").agg(F.sum(F.coalesce("reviewed", "amount")).alias("amount"), F.count("reviewed").alias("n_reviewed"))


def jn05_versioned_review(spark, sf_dir):
    """A review counts only where it saw the same version: here, the same year."""
    reviews = view(spark, sf_dir, "evidence").select("evidence_id", F.col("year").alias("seen"), F.lit(True).alias("reviewed"))
    r = _records(spark, sf_dir)
    joined = r.join(reviews, (r["evidence_id"] == reviews["evidence_id"]) & (r["year"] == reviews["seen"]), "left")
    return joined.groupBy("kind").agg(F.count("reviewed").alias("valid"), F.count_if(F.col("reviewed").isNull()).alias("void"))


def jn06_not_in_new(spark, sf_dir):
    return view(spark, sf_dir, "evidence").join(_records(spark, sf_dir).where("kind = 'fee'"), "evidence_id", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


def jn07_shared_ids(spark, sf_dir):
    e = view(spark, sf_dir, "evidence")
    return e.where("status = 'F'").select("source_id").distinct().join(e.where("status = 'O'").select("source_id").distinct(), "source_id", "left_semi")


def jn15_paired(spark, sf_dir):
    r = _records(spark, sf_dir).groupBy("evidence_id", "kind").agg(F.sum("amount").alias("amount"))
    a, b = (r.where(F.col("kind") == k).select("evidence_id", F.col("amount").alias(n)) for k, n in (("cutoff", "baseline"), ("fee", "candidate")))
    return a.join(b, "evidence_id").select("evidence_id", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("diff"))


def jn01_tickets(spark, sf_dir):
    orders, customer = view(spark, sf_dir, "orders"), view(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).where("o_orderstatus = 'P' and c_mktsegment = 'MACHINERY'")
    return joined.select("o_orderkey", "o_custkey", "o_orderdate", "c_name").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "o_custkey", "c_name")


def agg01_by_two_keys(spark, sf_dir):
    return validated(_records(spark, sf_dir)).groupBy("kind", F.when(F.col("reject_reason").isNull(), "valid").otherwise("rejected").alias("review_status")).agg(F.count("*").alias("n"))


def agg23_facets(spark, sf_dir):
    return facets(_records(spark, sf_dir), ["kind", "year", "authority", "programme", "seat_category", "quota"])


def agg24_total_and_page(spark, sf_dir):
    """The first page of the rows found, with the count of them all: a top-k and a one-row count."""
    found = exact_lookup(_records(spark, sf_dir), kind="date", quota="F")
    page = found.orderBy(F.desc("amount"), "record_id", "programme").limit(25)
    return page.join(F.broadcast(found.agg(F.count("*").alias("total"))), F.lit(True)).select("record_id", "amount", "total")


def agg25_table_counts(spark, sf_dir):
    names = ("orders", "lineitem", "events", "documents", "conversations")
    return reduce(DataFrame.unionByName, [view(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def agg13_cart_totals(spark, sf_dir):
    paise = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(paise).alias("total_paise"), F.sum(F.col("l_quantity").cast("bigint")).alias("items"))


def agg04_corpus_stats(spark, sf_dir):
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    d = view(spark, sf_dir, "documents").select("lang", words.alias("words"), F.length("text").alias("chars"))
    return d.rollup("lang").agg(F.count("*").alias("docs"), F.sum("words").alias("words"), F.sum("chars").alias("chars"), F.floor(F.sum("words") * 1.3).alias("est_tokens")).withColumn("lang", F.coalesce("lang", F.lit("all")))


def set01_keyed_merge(spark, sf_dir):
    """Later rows replace earlier ones of the same key (OPS01 has the same shape)."""
    r = _records(spark, sf_dir)
    last = W.partitionBy("evidence_id", "kind").orderBy(F.desc("year"), F.desc("record_id"), F.desc("amount"))
    return r.withColumn("rn", F.row_number().over(last)).where("rn = 1").select("evidence_id", "kind", "year", "amount")


def set02_gained_lost(spark, sf_dir):
    r = _records(spark, sf_dir)
    a, b = r.where("year = 1996").select("programme", "seat_category", "round"), r.where("year = 1997").select("programme", "seat_category", "round")
    gained, lost = b.subtract(a).withColumn("change", F.lit("gained")), a.subtract(b).withColumn("change", F.lit("lost"))
    return gained.unionByName(lost).unionByName(a.intersect(b).withColumn("change", F.lit("kept")))


def set03_multiset_difference(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.where("quota = 'F'").select("programme", "round").exceptAll(r.where("quota = 'O'").select("programme", "round")).groupBy("programme", "round").agg(F.count("*").alias("n"))


def ops05_lifecycle(spark, sf_dir):
    """Owner and state of sources, set from a list of updates."""
    updates = view(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.when(F.col("n_regionkey") == 1, "retired").alias("state"), F.concat(F.lit("owner-"), F.col("n_name")).alias("owner"))
    return view(spark, sf_dir, "supplier").join(updates, "s_nationkey", "left").select("s_suppkey", F.coalesce("state", F.lit("active")).alias("state"), F.coalesce("owner", F.lit("unassigned")).alias("owner"))


QUERIES = {n: f for n, f in list(globals().items()) if n[:3] in ("flt", "prj", "srt", "jn0", "jn1", "agg", "set", "ops") and callable(f)}

_REJECT = """case when year is null then 'missing year' when coalesce(authority,'')='' then 'missing authority' when coalesce(round,'')='' then 'missing round' when coalesce(programme,'')='' then 'missing programme'
    when coalesce(quota,'')='' then 'missing quota' when coalesce(seat_category,'')='' then 'missing seat_category'
    when kind='cutoff' and coalesce(closing_rank,'')='' then 'missing closing_rank'
    when kind='cutoff' and not regexp_full_match(closing_rank, '\\d+(\\.\\d+)?P?') then 'bad closing_rank'
    when kind='cutoff' and cast(rtrim(opening_rank,'P') as double) > cast(rtrim(closing_rank,'P') as double) then 'opening after closing'
    when kind='fee' and coalesce(amount,0) <= 0 then 'bad amount' end""".replace("\\\\", "\\")
_LABEL = "concat_ws(' | ', authority, cast(year as varchar), 'round ' || round, programme, seat_category, 'closing rank ' || nullif(closing_rank,''))"

SQL = {
    "flt08_exact_lookup": oracle("select record_id, year, round, programme, closing_rank, amount from records where kind='cutoff' and authority='authority-2' and quota='F'", "records"),
    "flt12_row_validation": oracle(f"select kind, coalesce({_REJECT}, 'valid') as outcome, count(*) as n from records group by all", "records"),
    "flt13_critical_gate": oracle("select kind, case when kind not in ('fee','date','cutoff','scholarship','finance') then 'auto_approved' when e.evidence_id is not null then 'approved' else 'pending' end as review_status, count(*) as n from records r left join (select evidence_id from evidence where status='F') e on e.evidence_id = r.evidence_id group by all", "records", "evidence"),
    "flt09_facet_filter": oracle("select programme, count(*) as n, cast(sum(amount) as bigint) as amount from records where year=1997 and seat_category='category-1' group by all", "records"),
    "flt10_like_search": oracle(f"select programme, count(*) as n from records where {_LABEL} ilike '%PROGRAMME-7%' or closing_rank ilike '%5p%' group by all", "records"),
    "prj05_label": oracle(f"select {_LABEL} as label, count(*) as n from records group by all", "records"),
    "prj06_display_value": oracle("select kind, coalesce(case when kind='fee' then cast(amount as varchar) end, nullif(closing_rank,''), nullif(opening_rank,'1'), '-') as value, count(*) as n from records group by all", "records"),
    "prj08_money": "select l_orderkey, l_linenumber, l_partkey, '₹' || format('{:,}', p // 100) || '.' || lpad(cast(p % 100 as varchar), 2, '0') as price from (select *, cast(round(l_extendedprice * 100) as bigint) as p from lineitem)",
    "srt01_lookup_order": oracle("select record_id, year, round, programme, seat_category, quota, amount, closing_rank from records where kind='cutoff' order by year desc, cast(round as int) desc, programme, seat_category, quota, record_id, amount, closing_rank nulls first limit 50", "records"),
    "srt02_facet_page": oracle("select record_id, year, authority, programme, round, seat_category, amount from records where quota='O' order by year desc, authority, programme, cast(round as int), seat_category, record_id, amount limit 40", "records"),
    "jn02_record_evidence": oracle("select kind, e.status as evidence_status, title, count(*) as n, cast(sum(amount) as bigint) as amount from records r join evidence e using (evidence_id) group by all", "records", "evidence"),
    "jn04_override": oracle("select kind, cast(sum(case when e.evidence_id is not null then 0 else amount end) as bigint) as amount, count(e.evidence_id) as n_reviewed from records r left join (select * from evidence where title='1-URGENT') e using (evidence_id) group by all", "records", "evidence"),
    "jn05_versioned_review": oracle("select kind, count(e.evidence_id) as valid, count(*) - count(e.evidence_id) as void from records r left join evidence e on e.evidence_id = r.evidence_id and e.year = r.year group by all", "records", "evidence"),
    "jn06_not_in_new": oracle("select status, count(*) as n from evidence where evidence_id not in (select evidence_id from records where kind='fee') group by all", "records", "evidence"),
    "jn07_shared_ids": oracle("select source_id from evidence where status='F' intersect select source_id from evidence where status='O'", "evidence"),
    "jn15_paired": oracle("select a.evidence_id, a.s as baseline, b.s as candidate, b.s - a.s as diff from (select evidence_id, cast(sum(amount) as bigint) as s from records where kind='cutoff' group by all) a join (select evidence_id, cast(sum(amount) as bigint) as s from records where kind='fee' group by all) b using (evidence_id)", "records"),
    "jn01_tickets": "select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey where o_orderstatus='P' and c_mktsegment='MACHINERY' order by o_orderdate desc, o_orderkey limit 100",
    "agg01_by_two_keys": oracle(f"select kind, case when {_REJECT} is null then 'valid' else 'rejected' end as review_status, count(*) as n from records group by all", "records"),
    "agg23_facets": oracle("select distinct facet, value from (" + " union all ".join(f"select '{c}' as facet, cast({c} as varchar) as value from records" for c in ("kind", "year", "authority", "programme", "seat_category", "quota")) + ") where value is not null", "records"),
    "agg24_total_and_page": oracle("select record_id, amount, total from (select *, count(*) over () as total from records where kind='date' and quota='F') order by amount desc, record_id, programme limit 25", "records"),
    "agg25_table_counts": " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("orders", "lineitem", "events", "documents", "conversations")),
    "agg13_cart_totals": "select l_orderkey, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as total_paise, cast(sum(cast(l_quantity as bigint)) as bigint) as items from lineitem group by all",
    "agg04_corpus_stats": "select coalesce(lang,'all') as lang, count(*) as docs, cast(sum(w) as bigint) as words, cast(sum(length(text)) as bigint) as chars, cast(floor(sum(w) * 1.3) as bigint) as est_tokens from (select lang, text, len(regexp_extract_all(text, '\\S+')) as w from documents) group by rollup(lang)".replace("\\\\", "\\"),
    "set01_keyed_merge": oracle("select evidence_id, kind, year, amount from records qualify row_number() over (partition by evidence_id, kind order by year desc, record_id desc, amount desc) = 1", "records"),
    "set02_gained_lost": oracle("select *, 'gained' as change from (select programme, seat_category, round from records where year=1997 except select programme, seat_category, round from records where year=1996) union all select *, 'lost' from (select programme, seat_category, round from records where year=1996 except select programme, seat_category, round from records where year=1997) union all select *, 'kept' from (select programme, seat_category, round from records where year=1997 intersect select programme, seat_category, round from records where year=1996)", "records"),
    "set03_multiset_difference": oracle("select programme, round, count(*) as n from (select programme, round from records where quota='F' except all select programme, round from records where quota='O') group by all", "records"),
    "ops05_lifecycle": "select s_suppkey, case when n_regionkey = 1 then 'retired' else 'active' end as state, coalesce('owner-' || n_name, 'unassigned') as owner from supplier left join nation on n_nationkey = s_nationkey",
}
