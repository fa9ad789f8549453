"""Every engine query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from hyperdelta import queries
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf, name):
    df = queries.QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())


def test_retraction_anchors(spark):
    from hyperdelta.operators.negation import negated_ids
    from hyperdelta.sources import bridge

    log = bridge.events(spark, "/root/testdata/sf0.01")
    for asof, total, events in ((None, 2667, 1667), (1705276800000, 1124, 724)):
        gone = negated_ids(log, asof)
        assert (gone.count(), gone.where("id LIKE 'evt/%'").count()) == (total, events)


def test_depth3_opens_every_order(spark, sf):
    got = queries.QUERIES["nested_depth3_all"](spark, sf)
    assert got.where("region IS NOT NULL").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_guard_and_upserts_take_every_customer(spark, tmp_path):
    """Customers beyond the ids that nested_self_guard and upsert_negations stop at."""
    customers = [(i, f"c{i}", 0, float(i), "M") for i in (7, 301, 302, 9001)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(2).withColumn("o_custkey", F.lit(9001).cast("long"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["object_id"]: (r["opened"], r["guarded"]) for r in queries.QUERIES["nested_self_guard_all"](spark, str(tmp_path)).collect()}
    assert got == {"customer/7": (0, 1), "customer/301": (0, 1), "customer/302": (0, 1), "customer/9001": (2, 1)}
    assert queries.QUERIES["upsert_negations_all"](spark, str(tmp_path)).count() == 8
