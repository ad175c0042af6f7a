"""Every query against its oracle on the smallest tables."""

import pytest
from oracle import connect, oracle_rows, rows_of

from provenspark.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, small, con, name):
    assert rows_of(QUERIES[name](spark, small)) == oracle_rows(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"components"}))
def test_query_without_oracle_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 1


def test_a_slow_stream_is_waited_for(spark, small, monkeypatch):
    """A wait with a limit that runs out must not pass off what is written so far as the whole; rows come from files, not from the driver."""
    from pyspark.sql.streaming import StreamingQuery

    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self) if timeout is None else False)
    found = QUERIES["stream_segments"](spark, small)
    assert found.count() == spark.read.parquet(f"{small}/conversations.parquet").count()
    assert found.inputFiles()


def test_components_equal_union_find(spark, small):
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for r in spark.read.parquet(f"{small}/lineitem.parquet").select("l_partkey", "l_orderkey").distinct().collect():
        p, q = sorted((find(f"p{r.l_partkey}"), find(f"o{r.l_orderkey}")))
        least[q] = p
    assert {r.node: r.component for r in QUERIES["components"](spark, small).collect()} == {n: find(n) for n in least}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
