"""What showed only on larger tables: ties, groups that meet, stock of many sessions, passages in many texts."""

import datetime
import json
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from compare import SMALL, rows_of_duckdb, rows_of_spark
from pyspark.sql import functions as F

from sparkwell import catalog
from sparkwell.operators import passages
from sparkwell.streaming.ledger import ledger, preview_token
from sparkwell.streaming.sessions import replay
from sparkwell.streaming.utterances import STATE


def _lines(rows):
    """A lineitem table of (order, line, part, price)."""
    day = datetime.datetime(1997, 3, 1)
    fixed = dict(l_suppkey=1, l_quantity=3.0, l_discount=0.0, l_tax=0.0, l_returnflag="A", l_linestatus="O", l_shipdate=day)
    named = [dict(l_orderkey=o, l_linenumber=n, l_partkey=p, l_extendedprice=float(x), **fixed) for o, n, p, x in rows]
    return pa.Table.from_pylist(named)


def test_follow_up_does_not_depend_on_the_order_of_tied_lines(spark, tmp_path):
    """Lines of one number and amount differ in their category; the next line asks after the last of them."""
    rows = [(o, n, p, 100) for o in range(12) for n, p in ((1, 0), (2, o), (2, o + 1), (2, o + 3), (3, 2))]
    found = []
    for k, order in enumerate((rows, rows[::-1])):
        at = tmp_path / str(k)
        at.mkdir()
        pq.write_table(_lines(order), at / "lineitem.parquet")
        found.append(rows_of_spark(catalog.queries()["txt33_follow_up"](spark, str(at))))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/0/lineitem.parquet'")
    closed = catalog.oracle_sql()["txt33_follow_up"].replace("order by record_id, amount)", "order by record_id, amount, seat_category)")
    assert found[0] == found[1] == rows_of_duckdb(con, closed)


def _orders(tmp_path, orders, lines, customers):
    """Tables of orders (key, customer, day or None), lines (order, day or None) and customers (key, nation)."""
    day = lambda n: None if n is None else datetime.datetime(1997, 1, 1) + datetime.timedelta(days=n)
    stamp = pa.timestamp("us")
    tables = {
        "orders": pa.table({"o_orderkey": pa.array([o[0] for o in orders], pa.int64()), "o_custkey": pa.array([o[1] for o in orders], pa.int64()), "o_orderdate": pa.array([day(o[2]) for o in orders], stamp), "o_orderpriority": [("high", "low")[o[1] % 2] for o in orders]}),
        "lineitem": pa.table({"l_orderkey": pa.array([x[0] for x in lines], pa.int64()), "l_shipdate": pa.array([day(x[1]) for x in lines], stamp)}),
        "customer": pa.table({"c_custkey": pa.array([c[0] for c in customers], pa.int64()), "c_nationkey": pa.array([c[1] for c in customers], pa.int32())}),
    }
    con = duckdb.connect()
    for name, table in tables.items():
        pq.write_table(table, tmp_path / f"{name}.parquet")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    return con


def _largest(df, kind_of, metric="numOutputRows"):
    """The most rows that a node of a kind in an executed plan made."""

    def nodes(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            yield from nodes(plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan())
            return
        yield kind, plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    made = [m.get().value() for kind, p in nodes(df._jdf.queryExecution().executedPlan()) if kind_of in kind and (m := p.metrics().get(metric)).isDefined()]
    assert made
    return max(made)


def test_open_orders_with_equal_numbers_nulls_and_reversed_days(spark, tmp_path):
    r = random.Random(5)
    some = lambda n, k: None if r.random() < 0.05 else r.randrange(n) - k
    orders = [(some(60, 0), r.randrange(12), some(40, 0)) for _ in range(300)]
    lines = [(some(70, 0), some(60, 10)) for _ in range(150)]
    con = _orders(tmp_path, orders, lines, [(k, some(3, 0)) for k in range(12)] + [(3, 1), (4, 1)])
    df = catalog.queries()["jn10_open_orders"](spark, str(tmp_path))
    want = rows_of_duckdb(con, catalog.oracle_sql()["jn10_open_orders"])
    assert rows_of_spark(df) == want and len(want[1]) > 4


def test_open_orders_of_one_group_make_no_pairs(spark, tmp_path):
    """n orders that are all open at once: n * (n - 1) meetings, of which none is a row."""
    n = 3000
    _orders(tmp_path, [(k, 0, 0) for k in range(n)], [(k, 5) for k in range(n)], [(0, 7)])
    df = catalog.queries()["jn10_open_orders"](spark, str(tmp_path))
    assert [(r.nation, r.priority, r.meetings, r.orders) for r in df.collect()] == [(7, "high", n * (n - 1), n)]
    assert _largest(df, "Join") <= n


class _Map:
    """A map state that counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self.values[key]


def test_buckets_keep_every_row_and_split_with_few_calls():
    from sparkwell.streaming.ledger import Buckets

    r, state, want, size = random.Random(3), _Map(), {}, 0
    for n in (1, 40, 2, 3000, 5, 700, 20_000, 30):  # rows named in a call
        now, before = Buckets(state, size), state.calls
        for name in (f"s{r.randrange(4 * len(want) + 50)}" if r.random() < 0.7 else f"t{r.randrange(50)}" for _ in range(n)):
            assert now.get(name) == want.get(name)
            if now.get(name) is None or r.random() < 0.5:
                want[name] = {"v": r.random()}
                now.put(name, want[name])
        size = now.store()
        assert size == len(want)
        assert state.calls - before < 100 + 20 * n and (n < 20_000 or state.calls - before < n)
    stored = [json.loads(v[0]) for v in state.values.values()]
    assert sum(map(len, stored)) == len(want) and {k: v for b in stored for k, v in b.items()} == want


def test_ledger_does_not_depend_on_the_order_of_actions_of_one_time(spark, tmp_path):
    """Two sessions take the last pieces of a product at one time."""
    none = dict.fromkeys(("session", "turn", "product", "quantity", "unit", "price", "token"))
    actions = [none | dict(shop=1, at=0, seq=None, name="restock", product="a", quantity=3, unit="box", price=5)]
    for turn, at, name, rest in (("t", 1, "add", dict(product="a", quantity=2, unit="box")), ("u", 2, "checkout", {}), ("v", 3, "confirm", {})):
        actions += [none | dict(shop=1, at=at, seq=None if at == 1 else 1, session=s, turn=turn, name=name, token=preview_token(s, "u") if name == "confirm" else None) | rest for s in ("x", "y", "z")]
    actions.append(none | dict(shop=0, at=10**6, seq=0, name="checkout", session="end"))
    kinds = dict(shop=pa.int64(), at=pa.timestamp("us", "UTC"), seq=pa.int64(), quantity=pa.int64(), price=pa.int64())
    found = []
    for k, order in enumerate((actions, actions[::-1])):
        at = tmp_path / f"{k}"
        at.mkdir()
        pq.write_table(pa.table({c: pa.array([(a[c] + 9) * 10**6 if c == "at" else a[c] for a in order], kinds.get(c, pa.string())) for c in actions[0]}), at / "a.parquet")
        done = replay(spark, str(at), lambda a: ledger(a, "2 seconds"), conf=STATE)
        found.append(sorted(map(tuple, done.select("us", "session", "name", "outcome", "total").collect()), key=str))
    assert found[0] == found[1] and [f[1] for f in found[0] if f[3] == "order"] == ["x"]


def test_ledger_query_gives_an_outcome_to_every_action(spark):
    """Those of the last hour, too."""
    from sparkwell.streaming.ledger import actions_of_orders

    done = catalog.queries()["str15_ledger"](spark, SMALL).groupBy("shop").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, actions_of_orders(spark, SMALL).groupBy("shop").count().collect()))


def test_texts_give_only_grams_of_passages_when_there_are_many_passages(spark, monkeypatch):
    """More passages than hashes are sent for: a text's other grams stay where they are."""
    monkeypatch.setattr(passages, "SENT", 0)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(5000)) for _ in range(20)]
    quotes = [t[k:k + 60] for k, t in enumerate(texts)] + ["ab", "h" * 40, "never said: " + texts[0][:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = passages.contained(spark.createDataFrame(list(enumerate(quotes)), "passage_id long, passage string"), docs)
    want = {(q, d, k, k + len(p)) for q, p in enumerate(quotes) for d, t in enumerate(texts) for k in range(len(t)) if t.startswith(p, k)}
    assert set(map(tuple, found.select("passage_id", "doc_id", "start", "stop").collect())) == want and len(want) > 20
    assert _largest(found, "MapInArrow", "pythonNumRowsReceived") < 2 * len(want) + 100
