"""Joins of points and intervals with intervals, whose rows don't grow with the length of an interval.

An interval belongs to the level of its length, the least power of two that holds it, and lies in one or two bins of
that size; a point lies in one bin of each level that occurs. They are joined by equal bins and then compared.
Where only the number of points is asked for, no pair is made: it is a difference of two running counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkwell.plans.views import oracle, view


def _level(start: Column, stop: Column) -> Column:
    """The least k for which 2^k is at least the number of whole points of the interval."""
    return F.length(F.bin(stop - start)) - F.when(stop == start, 1).otherwise(0)


def covering(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, on: list[str] | None = None) -> DataFrame:
    """All columns of each point and of each interval that covers it, both ends included; whole numbers.

    on: columns that both have and that must agree. Nulls, and intervals that end before they begin, meet nothing.
    """
    on = on or []
    kept = intervals.where(F.col(start) <= F.col(stop)).withColumn("_level", _level(F.col(start), F.col(stop)))
    levels = sorted(r[0] for r in kept.select("_level").distinct().collect())  # 64 at most
    bin_of = lambda x: F.floor(F.col(x) / F.pow(F.lit(2), F.col("_level"))).cast("long") if not levels or levels[-1] > 40 else F.expr(f"shiftright(cast(`{x}` as long), _level)")
    binned = kept.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(start), bin_of(stop)))))
    dealt = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bin_of(at))
    return dealt.join(binned, [*on, "_level", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(stop))).drop("_level", "_bin")


def counted(points: DataFrame, intervals: DataFrame, at: str, start: str, stop: str, on: list[str]) -> DataFrame:
    """Each interval with inside, how many points it covers, both ends included; what covering() leaves out is left out, intervals that cover nothing have 0.

    on: columns that both have and that must agree. Only the different values of a group are put in order, never its rows.
    """
    whole = [F.col(c).isNotNull() for c in on]
    kept = intervals.where(F.col(start) <= F.col(stop))
    for c in whole:
        kept, points = kept.where(c), points.where(c)
    places = points.where(F.col(at).isNotNull()).select(*on, F.col(at).cast("long").alias("_x"), F.lit(1).alias("_n"))
    for end in (start, stop):
        places = places.unionByName(kept.select(*on, F.col(end).cast("long").alias("_x"), F.lit(0).alias("_n")))
    own = places.groupBy(*on, "_x").agg(F.sum("_n").alias("_n"))
    upto = own.withColumn("_upto", F.sum("_n").over(W.partitionBy(*on).orderBy("_x").rowsBetween(W.unboundedPreceding, 0)))
    before = upto.select(*on, F.col("_x").alias(start), (F.col("_upto") - F.col("_n")).alias("_before"))
    met = kept.join(before, [*on, start]).join(upto.select(*on, F.col("_x").alias(stop), "_upto"), [*on, stop])
    return met.select(*intervals.columns, (F.col("_upto") - F.col("_before")).alias("inside"))


def overlapping(a: DataFrame, b: DataFrame, key_a: str, key_b: str, on: list[str] | None = None) -> DataFrame:
    """The keys of intervals (key, start, stop) that have a point in common: one of the two then begins inside the other."""
    on = on or []
    side = lambda df, key: df.select(*on, F.col(key), F.col("start").alias(f"_s_{key}"), F.col("stop").alias(f"_e_{key}")).where("start <= stop")
    one, two = side(a, key_a), side(b, key_b)
    inside = covering(one, two, f"_s_{key_a}", f"_s_{key_b}", f"_e_{key_b}", on)
    around = covering(two, one, f"_s_{key_b}", f"_s_{key_a}", f"_e_{key_a}", on).where(F.col(f"_s_{key_b}") > F.col(f"_s_{key_a}"))
    columns = [*on, key_a, key_b]
    return inside.select(*columns).unionByName(around.select(*columns))


def jn10_page_interval(spark, sf_dir):
    """Page units of a source and the blocks whose pages cover them."""
    b = view(spark, sf_dir, "blocks")
    units = b.select("source_id", F.col("page_start").cast("long").alias("page")).union(b.select("source_id", F.col("page_end").cast("long"))).distinct()
    met = covering(units, b.select("source_id", "block_id", "page_start", "page_end"), "page", "page_start", "page_end", ["source_id"])
    return met.groupBy("source_id", "page").agg(F.count("*").alias("blocks"), F.min("block_id").alias("first"))


def jn10_open_orders(spark, sf_dir):
    """How many other orders of a customer's nation and priority were placed while an order's lines were still to be shipped: intervals of days of any length."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    lines = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("stop"))
    o = view(spark, sf_dir, "orders").join(view(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = o.select("o_orderkey", F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("priority"), day("o_orderdate").alias("start"))
    intervals = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("nation", "priority", "o_orderkey", "start", "stop")
    points = orders.where("o_orderkey is not null").select("nation", "priority", F.col("start").alias("at"))
    # orders of the same number don't meet: their last day is the same, so those from a start on are the ones inside; the earliest start meets all that a later one does
    same = W.partitionBy("nation", "priority", "o_orderkey").orderBy("start")
    kept = intervals.where("start <= stop").withColumns({"own": F.count("*").over(same.rangeBetween(0, W.unboundedFollowing)), "nth": F.row_number().over(same)})
    others = counted(points, kept, "at", "start", "stop", ["nation", "priority"]).withColumn("n", F.col("inside") - F.col("own"))
    met = others.groupBy("nation", "priority").agg(F.sum("n").alias("meetings"), F.count_if((F.col("nth") == 1) & (F.col("n") > 0)).alias("orders"))
    return met.where("meetings > 0")


QUERIES = {"jn10_page_interval": jn10_page_interval, "jn10_open_orders": jn10_open_orders}

SQL = {
    "jn10_page_interval": oracle("select u.source_id, page, count(*) as blocks, min(block_id) as first from (select source_id, cast(page_start as bigint) as page from blocks union select source_id, page_end from blocks) u join blocks b on b.source_id = u.source_id and page between page_start and page_end group by all", "blocks"),
    "jn10_open_orders": "with l as (select l_orderkey, max(date_diff('day', date '1970-01-01', cast(l_shipdate as date))) as stop from lineitem group by all), o as (select o_orderkey, c_nationkey as nation, o_orderpriority as priority, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as start from orders join customer on o_custkey = c_custkey) select a.nation, a.priority, count(*) as meetings, count(distinct a.o_orderkey) as orders from (select * from o join l on o_orderkey = l_orderkey) a join o b on a.nation = b.nation and a.priority = b.priority and b.start between a.start and a.stop and a.o_orderkey <> b.o_orderkey group by all",
}
