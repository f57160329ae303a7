"""Registered queries against their SQL on tables made here, and the driver's contract."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelloom.operators import layout
from panelloom.plans import queries as Q
from panelloom.streaming.ingest import keyed_cusum, read_events


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Small tables with ties, repeated rows and 30 days of events."""
    d = tmp_path_factory.mktemp("sf")
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=73 * i), rng.randrange(12), rng.choice(["click", "view", "purchase", "error", "signup"]), round(rng.uniform(1, 150), 2), "{}") for i in range(590)]
    orders = [(i, i % 40, "O", round(rng.uniform(1e3, 5e5), 2), datetime.datetime(1996, 1, 1) + datetime.timedelta(days=rng.randrange(700)), rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])) for i in range(3000)]
    customer = [(i, f"c{i}", i % 5, 1.0, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"][i % 4]) for i in range(40)]
    tables = {
        "events": (events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": (customer, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(i, f"n{i}", i % 2) for i in range(5)], "n_nationkey int, n_name string, n_regionkey int"),
        "lineitem": ([("A", "F"), ("A", "F"), ("N", "O"), (None, "O")], "l_returnflag string, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{d}/{name}.parquet")
    return f"file://{d}"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "nation", "lineitem"):
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir.removeprefix('file://')}/{t}.parquet/*.parquet')")
    return con


KEY = lambda r: tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = Q.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=KEY)
    want = sorted(duck.sql(f"select {', '.join(cols)} from ({Q.ORACLES[name]})").fetchall(), key=KEY)
    assert got == want
    spark.catalog.clearCache()


def test_contract_and_independence(spark):
    names = entry.queries()
    assert set(Q.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)


def test_layouts_refuse_uneven_pages(spark):
    with pytest.raises(ValueError):
        layout.to_page(spark.createDataFrame([(0, 0, 0, 1.0)], "unit_idx int, time_idx int, action_idx int, value double"), 7, 2)
    cells = spark.range(60).select((F.col("id") % 2).cast("int").alias("unit_idx"), (F.col("id") / 2 % 10).cast("int").alias("time_idx"), (F.col("id") / 20).cast("int").alias("action_idx"))
    for there, back in ((layout.to_page, layout.from_page), (layout.to_horizontal_page, layout.from_horizontal_page)):
        args = (10, 5) if there is layout.to_page else (10, 3, 5)
        again = back(there(cells, *args).select("row_id", "col_id"), *args).select("unit_idx", "time_idx", "action_idx")
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, cells.collect()))
    assert layout.parameter_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_keyed_cusum_keeps_state_between_batches(spark, tmp_path):
    rows = [(i, datetime.datetime(2024, 1, 1, 0, i), 1, "x", float(v), "{}") for i, v in enumerate([3, 1, 5, 0, 9])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    for k in range(2):
        df.where((F.col("event_id") < 3) == (k == 0)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/e")
    out = []
    q = keyed_cusum(read_events(spark, f"file://{tmp_path}/e", 1), 2.0).writeStream.outputMode("update").foreachBatch(lambda d, i: out.extend(d.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert out[-1]["n"] == 5 and {r["n"] for r in out} in ({5}, {3, 5}, {2, 5})
