"""Scores at halves of the sixth place, against the oracles."""

import duckdb
import pytest
from pyspark.sql import functions as F

from provenspark.plans import catalogue


@pytest.fixture(scope="module")
def halves(spark, small, tmp_path_factory):
    """The smallest tables with prices whose five hundred thousandth is half of a millionth."""
    path = str(tmp_path_factory.mktemp("halves"))
    for t in ("customer", "supplier", "nation", "lineitem"):
        spark.read.parquet(f"{small}/{t}.parquet").coalesce(1).write.parquet(f"{path}/{t}.parquet")
    orders = spark.read.parquet(f"{small}/orders.parquet").withColumn("o_totalprice", F.floor("o_totalprice") + 0.25 + F.col("o_orderkey") % 2 * 0.5)
    orders.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def oracle(folder, sql):
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return {(q, n): s for q, n, s in con.execute(sql).fetchall()}


def test_entity_bridge_at_halves(spark, halves):
    found = catalogue.queries()["entity_bridge"](spark, halves).select("query_id", "node", "score").collect()
    assert {(r[0], r[1]): r[2] for r in found} == oracle(halves, catalogue.oracle_sql()["entity_bridge"])


def test_assoc_spread_at_halves(spark, halves):
    found = catalogue.queries()["assoc_spread"](spark, halves).select("query_id", "node", "score").collect()
    assert {(r[0], r[1]): r[2] for r in found} == oracle(halves, catalogue.oracle_sql()["assoc_spread"])
