"""Operator 2: secrets found by pattern, told apart by who owns them, with built-in functions only.

Every whole text is matched against a few patterns. The values found are hashed, and over the whole
corpus each hash is counted by distinct repositories and distinct owners: a value that many owners
hold is a copied example, one that a single owner holds and that looks random is likely live. Only
hashes and places are moved; no text is shuffled. The counts are taken in two steps, of distinct
(hash, owner, repository) first, so that a value in a third of all rows collapses before it moves.

Defined cases: null or empty text has no spans; a null source counts as the owner ''; repeated rows
give repeated results (each its own); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import materialize, table, text_of

# The patterns of the contract, in Java's syntax, then those that this operator adds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
KINDS = ["assign", "access", "hex", "vendor"]
MIN_ASSIGN = 12

#: A value that so many owners hold is a copied example.
SHARED_OWNERS = 3
#: A live-looking value has this length, this many different characters, a digit and a letter.
LIVE_LENGTH, LIVE_ALPHABET = 16, 8

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


#: Matches are placed in blocks of this size, so that the work grows with their number.
BLOCK = 256


def _spans(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """The matches of a pattern with their places in code points: places follow from the lengths of what lies between matches.

    A fold that grows an array copies it in each step; so each block of matches is folded by itself,
    from where the blocks before it end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = (lambda hit: F.regexp_extract(hit, pattern, group)) if group else (lambda hit: hit)
    none = F.from_json(F.lit("[]"), SPAN)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        held = value(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), held.alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(held) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def placed(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))
        pairs = F.arrays_zip(blocks.alias("block"), F.slice(begins, 1, F.size(blocks)).alias("at"))
        return F.flatten(F.transform(pairs, lambda p: F.aggregate(p["block"], F.struct(p["at"].alias("at"), none.alias("spans")), step)["spans"]))

    def cut(parts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda k: F.slice(parts, k * BLOCK + 1, BLOCK))

    # each step is one element of an array of one, so that what it refers to is worked out once
    once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)
    zipped = once(found, lambda hits: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(hits)).alias("gap"), hits.alias("hit")))
    spans = once(once(zipped, cut), placed)
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(none)


def candidate_spans(text: Column) -> Column:
    """All spans of a text by start, then kind."""
    return F.array_sort(F.concat(
        _spans(text, "assign", ASSIGN, 2, MIN_ASSIGN),
        F.when(F.contains(text, F.lit("AKIA")), _spans(text, "access", ACCESS)).otherwise(F.from_json(F.lit("[]"), SPAN)),
        _spans(text, "hex", HEX),
        _spans(text, "vendor", VENDOR),
    ))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repositories of rows (hash, owner, repository)."""
    pairs = candidates.select("hash", "owner", "repository").distinct()
    return pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("_r")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("_r").alias("repositories"))


def _live(value: Column) -> Column:
    return (F.length(value) >= LIVE_LENGTH) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_ALPHABET)


def find_secrets(docs: DataFrame, owner: Column, repository: Column, shared_owners: int = SHARED_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, spans (start, rank, kind, end, hash, live) and the counts shared, owner_specific, live."""
    row = F.monotonically_increasing_id()
    hashed = F.transform("_spans", lambda x: F.struct(x["start"], x["rank"], x["kind"], x["end"], F.sha2(x["value"], 256).alias("hash"), _live(x["value"]).alias("live")))
    rows = docs.select("doc_id", F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"), candidate_spans(text_of()).alias("_spans"))
    rows = materialize(rows.select(row.alias("_row"), "doc_id", "owner", "repository", hashed.alias("spans")), "secrets")
    each = rows.where(F.size("spans") > 0).select("_row", "owner", "repository", F.explode("spans").alias("_s")).select("_row", "owner", "repository", "_s.hash", "_s.live")
    judged = each.join(materialize(ownership(each), "secret-owners"), "hash")  # a table of its own, so that the join may split a hash that many rows have
    counts = judged.groupBy("_row").agg(
        F.count_if(F.col("owners") >= shared_owners).alias("shared"),
        F.count_if(F.col("owners") == 1).alias("owner_specific"),
        F.count_if((F.col("owners") == 1) & F.col("live")).alias("live"),
        F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"),
    )
    none = [F.lit(0).cast("long").alias(c) for c in ("shared", "owner_specific", "live", "most_owners", "most_repositories")]
    with_spans = rows.where(F.size("spans") > 0).join(counts, "_row").select("doc_id", "spans", *counts.columns[1:])
    return with_spans.unionByName(rows.where(F.size("spans") == 0).select("doc_id", "spans", *none))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for the owner, a source's part in one language for the repository."""
    found = find_secrets(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "vendor")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.col("shared").alias("n_shared"), F.col("owner_specific").alias("n_owner_specific"), F.col("live").alias("n_live"), "most_owners", "most_repositories",
    )


def _found(kind: str, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"select rid, owner, repo, '{kind}' as kind, {KINDS.index(kind)} as rank, regexp_extract_all(t, {p}, 0) as hits, regexp_extract_all(t, {p}, {group}) as vals, regexp_split_to_array(t, {p}) as gaps from d"


ORACLE_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce(source, '') as owner, concat_ws('/', source, lang) as repo from documents),
k as ({_found("assign", ASSIGN, 2)} union all {_found("access", ACCESS, 0)} union all {_found("hex", HEX, 0)} union all {_found("vendor", VENDOR, 0)}),
s as (select *, unnest(range(1, len(hits) + 1)) as i from k where len(hits) > 0),
p as (select rid, owner, repo, kind, rank, vals[i] as v, length(hits[i]) as n,
             cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as a from s),
c as (select *, a || ':' || (a + n) as place, sha256(v) as hash,
             length(v) >= {LIVE_LENGTH} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and len(list_distinct(string_split(v, ''))) >= {LIVE_ALPHABET} as live
      from p where kind <> 'assign' or length(v) >= {MIN_ASSIGN}),
f as (select hash, count(distinct owner) as owners, count(distinct (owner, repo)) as repositories from c group by hash),
g as (select rid, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
             string_agg(kind || ':' || place, ',' order by a, rank) filter (where kind <> 'vendor') as base, string_agg(kind || ':' || place, ',' order by a, rank) as spans,
             count(*) filter (where owners >= {SHARED_OWNERS}) as n_shared, count(*) filter (where owners = 1) as n_owner_specific, count(*) filter (where owners = 1 and live) as n_live,
             max(owners) as most_owners, max(repositories) as most_repositories
      from c join f using (hash) group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_shared, 0) as n_shared, coalesce(n_owner_specific, 0) as n_owner_specific, coalesce(n_live, 0) as n_live, coalesce(most_owners, 0) as most_owners, coalesce(most_repositories, 0) as most_repositories
from d left join g using (rid)
"""
