"""Domain views over the test tables, written once in SQL that Spark and DuckDB both read.

The operators work on records, blocks, turns and measurements; these views give the driver's tables
those shapes, so that every operator runs over whole tables at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # typed facts: one for each order line
    "records": """
        select l_orderkey * 10 + l_linenumber as record_id,
               case l_returnflag when 'A' then 'cutoff' when 'N' then 'fee' else 'date' end as kind,
               cast(year(l_shipdate) as int) as year,
               concat('authority-', cast(l_suppkey % 5 as string)) as authority,
               cast(l_linenumber as string) as round,
               concat('programme-', cast(l_partkey % 20 as string)) as programme,
               l_linestatus as quota,
               concat('category-', cast(l_partkey % 4 as string)) as seat_category,
               case when l_tax > 0.07 then null when l_tax > 0.04 then '' else concat(cast(cast(l_quantity as int) * 10 as string), case when l_discount > 0.08 then 'P' else '' end) end as closing_rank,
               case when l_tax > 0.03 then cast(cast(l_quantity as int) * 7 as string) else '1' end as opening_rank,
               cast(round(l_extendedprice) as bigint) as amount,
               l_orderkey as evidence_id
        from {lineitem}""",
    # evidence blocks: one for each document
    "blocks": """
        select doc_id as block_id, source as source_id, lang as category, text,
               case cast(doc_id % 6 as int) when 0 then 'approved' when 1 then 'extracted' when 2 then 'machine_verified' when 3 then 'needs_review' when 4 then 'visual_only' else 'rejected' end as status,
               case when doc_id % 4 = 0 then null else 2015 + cast(doc_id % 9 as int) end as year,
               doc_id % 5 = 0 as historical,
               cast(1 + doc_id % 7 as int) as page_start, cast(1 + doc_id % 7 + doc_id % 3 as int) as page_end,
               n_chars
        from {documents}""",
    # timed turns of sessions: one for each event
    "turns": """
        select event_id as turn_id, user_id as session_id, ts, event_type as status, value as seconds,
               case when event_type = 'error' then null else value / 3.0 end as model_seconds,
               cast(event_id % 3 + 1 as int) as model_calls
        from {events}""",
    # the same cases under two systems: order lines as cases
    "evidence": """
        select o_orderkey as evidence_id, o_orderstatus as status, o_orderpriority as title, cast(year(o_orderdate) as int) as year, o_custkey as source_id
        from {orders}""",
    "vectors": "select vec_id, embedding, label from {embeddings}",
    "messages": "select conv_id, turn, role, text from {conversations}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _used(text: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table as it is."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    return spark.sql(text, **{t: view(spark, sf_dir, t) for t in _used(text)})


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL of a query over views."""
    ctes = [f"{n} as ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names]
    return ("with " + ", ".join(ctes) + " " if ctes else "") + body
