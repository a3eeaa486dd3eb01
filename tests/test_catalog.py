"""Every query of the library (without the llm subpackage) against its DuckDB SQL."""

import pytest
from compare import SMALL, database, rows_of_duckdb, rows_of_spark


from sparkwell import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    assert rows_of_spark(QUERIES[name](spark, SMALL)) == rows_of_duckdb(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitioning_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        found = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append([rows_of_spark(QUERIES[q](spark, SMALL)) for q in ("ret02_bm25", "evl18_family_split", "win13_eviction", "str09_ttl_cache")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
