"""Registered queries of the panel engine, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.functions import kernels
from panelloom.operators import bicluster, cp, drift, estimands, layout, metrics, mssa, panel, snn, synth
from panelloom.plans.model import PanelModel
from panelloom.sources.io import customer_orders, events_daily, nation_monthly
from panelloom.spec import AlsConfig, BiclusterConfig, CpConfig, ModelConfig, MssaConfig, PanelSpec, SnnConfig

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DAYS = 30
ACTIONS = 5

P1 = "p1 AS (SELECT user_id AS unit, CAST(ts AS DATE) AS time, arg_max(event_type, ts) AS action, round(sum(value), 2) AS metric FROM events GROUP BY 1, 2)"
P2 = """q AS (SELECT c_nationkey AS unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS time, o_orderpriority AS label, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
p2 AS (SELECT unit, time, arg_min(label, (-n, label)) AS action, round(sum(total), 2) AS metric FROM q GROUP BY 1, 2)"""
P3 = "p3 AS (SELECT o_custkey AS unit, CAST(o_orderdate AS DATE) AS time, o_orderpriority AS action, o_totalprice AS metric, c_mktsegment AS segment, n_regionkey AS region FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"
COO = (
    P1
    + """,
du AS (SELECT unit, (row_number() OVER (ORDER BY unit) - 1)::INT AS unit_idx FROM (SELECT DISTINCT unit FROM p1)),
dt AS (SELECT time, (row_number() OVER (ORDER BY time) - 1)::INT AS time_idx FROM (SELECT DISTINCT time FROM p1)),
da AS (SELECT action, (row_number() OVER (ORDER BY action) - 1)::INT AS action_idx FROM (SELECT DISTINCT action FROM p1)),
coo AS (SELECT unit_idx, time_idx, action_idx, metric AS value FROM p1 JOIN du USING (unit) JOIN dt USING (time) JOIN da USING (action))"""
)
CF = COO + """,
cf AS (SELECT unit, time, a.action, round(um * am / g, 6) AS value FROM (SELECT unit, avg(metric) AS um FROM p1 GROUP BY unit) u
  CROSS JOIN (SELECT DISTINCT time FROM p1) t CROSS JOIN (SELECT action, avg(metric) AS am FROM p1 GROUP BY action) a CROSS JOIN (SELECT avg(metric) AS g FROM p1) o)"""
SERIES = P1 + ", m AS (SELECT time, round(avg(metric), 6) AS value FROM p1 GROUP BY time), s AS (SELECT (row_number() OVER (ORDER BY time) - 1)::INT AS t, value FROM m)"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def dims(p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return panel.large_dimension(p, "unit"), panel.small_dimension(p, "time"), panel.small_dimension(p, "action")


def coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = events_daily(spark, sf_dir).persist()
    return panel.observed(panel.encode(p, *dims(p)))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, value): the panel's daily means, one row a day."""
    m = events_daily(spark, sf_dir).groupBy("time").agg(F.round(F.avg("metric"), 6).alias("value"))
    return m.select((F.row_number().over(Window.orderBy("time")) - 1).cast("int").alias("t"), "value")


def ratio_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, action, value): the rank-one table unit mean * action mean / mean."""
    p = events_daily(spark, sf_dir).persist()
    u, a, g = p.groupBy("unit").agg(F.avg("metric").alias("um")), p.groupBy("action").agg(F.avg("metric").alias("am")), p.agg(F.avg("metric").alias("g"))
    cells = u.crossJoin(F.broadcast(p.select("time").distinct())).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(g))  # times, actions and one row
    return cells.select("unit", "time", "action", F.round(F.col("um") * F.col("am") / F.col("g"), 6).alias("value"))


# ---------------------------------------------------------------- panels and dictionaries


@query(f"WITH {P1} SELECT * FROM p1")
def panel_events(spark, sf_dir):
    return events_daily(spark, sf_dir)


@query(f"WITH {P2} SELECT * FROM p2")
def panel_orders(spark, sf_dir):
    return nation_monthly(spark, sf_dir)


@query(f"WITH {COO} SELECT * FROM du")
def dim_unit(spark, sf_dir):
    return panel.large_dimension(events_daily(spark, sf_dir), "unit")


@query(f"WITH {COO} SELECT * FROM dt")
def dim_time(spark, sf_dir):
    return panel.small_dimension(events_daily(spark, sf_dir), "time")


@query(f"WITH {COO} SELECT * FROM da")
def dim_action(spark, sf_dir):
    return panel.small_dimension(events_daily(spark, sf_dir), "action")


@query("SELECT l_returnflag || '-' || l_linestatus AS action, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def composite_action(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return d.groupBy(panel.action_label(("l_returnflag", "l_linestatus")).alias("action")).agg(F.count("*").alias("n"))


@query(f"WITH {COO} SELECT * FROM coo")
def tensor_coo(spark, sf_dir):
    return coo(spark, sf_dir)


@query(f"WITH {COO} SELECT unit_idx, time_idx, action_idx FROM coo")
def assignment_table(spark, sf_dir):
    p = events_daily(spark, sf_dir)
    return panel.assignment(panel.encode(p, *dims(p)))


@query(f"WITH {P2} SELECT unit, " + ", ".join(f"round(sum(metric) FILTER (action LIKE '{k}-%'), 2) AS p{k}" for k in range(1, 6)) + " FROM p2 GROUP BY unit")
def metric_pivot(spark, sf_dir):
    p = nation_monthly(spark, sf_dir).groupBy("unit", F.concat(F.lit("p"), F.substring("action", 1, 1)).alias("time")).agg(F.round(F.sum("metric"), 2).alias("value"))
    return panel.to_wide(p, times=[f"p{k}" for k in range(1, 6)])


@query("SELECT user_id AS unit, CAST(ts AS DATE) AS time, count(*)::BIGINT AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return panel.duplicate_keys(e.select(F.col("user_id").alias("unit"), F.to_date("ts").alias("time")))


@query(f"WITH {P1} SELECT count(DISTINCT unit)::BIGINT AS n_units, count(DISTINCT time)::BIGINT AS n_times, count(DISTINCT action)::BIGINT AS n_actions, count(*)::BIGINT AS n_cells, round(count(*)::DOUBLE / (count(DISTINCT unit) * count(DISTINCT time) * count(DISTINCT action)), 6) AS density FROM p1")
def panel_density(spark, sf_dir):
    return panel.density(events_daily(spark, sf_dir))


@query(f"WITH {COO} SELECT unit_idx, time_idx FROM du CROSS JOIN dt WHERE (unit_idx, time_idx) NOT IN (SELECT (unit_idx, time_idx) FROM coo)")
def missing_cells(spark, sf_dir):
    p = events_daily(spark, sf_dir).persist()
    u, t, a = dims(p)
    return panel.missing_cells(panel.grid(u.select("unit_idx"), t.select("time_idx")), panel.encode(p, u, t, a))


@query(f"WITH {COO} SELECT time_idx, action_idx FROM dt CROSS JOIN da LEFT JOIN coo USING (time_idx, action_idx) GROUP BY 1, 2 HAVING count(value) <= 25")
def new_batch_nan_mask(spark, sf_dir):
    p = events_daily(spark, sf_dir).persist()
    u, t, a = dims(p)
    return panel.new_batch_mask(panel.observed(panel.encode(p, u, t, a)), panel.grid(t, a), 25)


@query(f"WITH {P1} SELECT unit, action, metric FROM p1 WHERE time > (SELECT max(time) FROM p1) - INTERVAL 7 DAY")
def last_window_split(spark, sf_dir):
    return panel.last_window(events_daily(spark, sf_dir), "7 days")[1].select("unit", "action", "metric")


@query(f"WITH {P3} SELECT unit, min(segment) AS segment, min(region)::INT AS region FROM p3 GROUP BY unit")
def unit_covariates(spark, sf_dir):
    return estimands.unit_covariates(customer_orders(spark, sf_dir), ["segment", "region"]).withColumn("region", F.col("region").cast("int"))


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{s}')::INT AS seg_{s[:4]}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.substring("c_mktsegment", 1, 4).alias("seg"))
    return panel.one_hot(c, "seg", ["AUTO", "BUIL", "FURN", "HOUS", "MACH"]).drop("seg")


@query(f"WITH {P3} SELECT DISTINCT segment, region::INT AS region FROM p3")
def distinct_covariates(spark, sf_dir):
    return customer_orders(spark, sf_dir).select("segment", F.col("region").cast("int").alias("region")).distinct()


# ---------------------------------------------------------------- layouts


@query(f"WITH {COO} SELECT unit_idx, time_idx, action_idx, value, (unit_idx * 5 + time_idx % 5)::INT AS row_id, (action_idx * 6 + time_idx // 5)::INT AS col_id FROM coo")
def page_layout(spark, sf_dir):
    return layout.to_page(coo(spark, sf_dir), DAYS, 5)


@query(f"WITH {COO} SELECT unit_idx, time_idx, action_idx, value FROM coo")
def page_roundtrip(spark, sf_dir):
    paged = layout.to_page(coo(spark, sf_dir), DAYS, 5).select("row_id", "col_id", "value")
    return layout.from_page(paged, DAYS, 5).select("unit_idx", "time_idx", "action_idx", "value")


@query(f"WITH {COO} SELECT (time_idx % 5)::INT AS row_id, ((unit_idx * 5 + action_idx) * 6 + time_idx // 5)::INT AS col_id, value FROM coo")
def horizontal_page(spark, sf_dir):
    return layout.to_horizontal_page(coo(spark, sf_dir), DAYS, ACTIONS, 5).select("row_id", "col_id", "value")


@query(f"WITH {SERIES} SELECT a.i::INT AS i, (t - a.i)::INT AS j, value FROM s CROSS JOIN range(5) a(i) WHERE t - a.i BETWEEN 0 AND 25")
def hankel_rows(spark, sf_dir):
    return layout.series_to_hankel(daily_series(spark, sf_dir), DAYS, 5)


@query(f"WITH {SERIES}, h AS (SELECT a.i AS i, t - a.i AS j, value * (a.i + 1) AS value FROM s CROSS JOIN range(5) a(i) WHERE t - a.i BETWEEN 0 AND 25) SELECT (i + j)::INT AS t, round(avg(value), 5) AS value FROM h GROUP BY 1")
def unhankel_mean(spark, sf_dir):
    h = layout.series_to_hankel(daily_series(spark, sf_dir), DAYS, 5).withColumn("value", F.col("value") * (F.col("i") + 1))
    return layout.hankel_to_series(h).select("t", F.round("value", 5).alias("value"))


@query(f"WITH {SERIES} SELECT (t % 7)::INT AS i, (t // 7)::INT AS j, value FROM s WHERE t < 28")
def page_series(spark, sf_dir):
    return layout.series_to_page(daily_series(spark, sf_dir), DAYS, 7)


@query(f"WITH {COO} SELECT time_idx, round(1 - count(value)::DOUBLE / (SELECT count(*) FROM du), 6) AS missing_share FROM coo GROUP BY 1 HAVING 1 - count(value)::DOUBLE / (SELECT count(*) FROM du) < 0.3")
def column_sparsity(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    n = c.select("unit_idx").distinct().count()
    return layout.column_sparsity(c, "time_idx", n).withColumn("missing_share", F.round("missing_share", 6))


# ---------------------------------------------------------------- anchors and blocks

MATRIX = COO + ", x AS (SELECT unit_idx AS row_id, (action_idx * 30 + time_idx)::INT AS col_id, value FROM coo)"


def matrix(spark, sf_dir):
    return layout.to_page(coo(spark, sf_dir), DAYS).select("row_id", "col_id", "value")


@query(f"WITH {MATRIX} SELECT row_id, string_agg(col_id::VARCHAR, ',' ORDER BY col_id) AS obs_cols, count(*)::INT AS n FROM x GROUP BY row_id")
def obs_rows_cols(spark, sf_dir):
    return snn.row_sets(matrix(spark, sf_dir)).select("row_id", F.array_join("obs_cols", ",").alias("obs_cols"), F.size("obs_cols").alias("n"))


@query(f"""WITH {MATRIX}, r AS (SELECT row_id, string_agg(col_id::VARCHAR, ',' ORDER BY col_id) AS rp FROM x GROUP BY 1), c AS (SELECT col_id, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS cp FROM x GROUP BY 1),
g AS (SELECT r.row_id, c.col_id, rp, cp FROM r CROSS JOIN c WHERE (r.row_id, c.col_id) NOT IN (SELECT (row_id, col_id) FROM x)) SELECT count(*)::BIGINT AS n_missing, count(DISTINCT (rp, cp))::BIGINT AS n_patterns FROM g""")
def pattern_dedupe(spark, sf_dir):
    x = matrix(spark, sf_dir).persist()
    grid = x.select("row_id").distinct().crossJoin(F.broadcast(x.select("col_id").distinct()))  # time steps by actions
    p = snn.missing_patterns(panel.missing_cells(grid, x), x)
    return p.agg(F.count("*").alias("n_missing"), F.countDistinct("row_pattern", "col_pattern").alias("n_patterns"))


@query(f"WITH {MATRIX} SELECT col_id, row_id, (ntile(3) OVER (PARTITION BY col_id ORDER BY row_id))::INT AS split FROM x")
def anchor_split_ntile(spark, sf_dir):
    def split(f: pd.DataFrame) -> pd.DataFrame:
        rows = np.sort(f["row_id"].to_numpy())
        parts = kernels.row_splits(rows, 3)
        return pd.DataFrame({"col_id": f["col_id"].iloc[0], "row_id": np.concatenate(parts), "split": np.repeat(np.arange(1, len(parts) + 1), [len(p) for p in parts])})

    return matrix(spark, sf_dir).select("col_id", "row_id").groupBy("col_id").applyInPandas(split, "col_id int, row_id int, split int")


MASK = COO + """,
mk AS (SELECT (unit_idx % 4 * 5 + time_idx % 5)::INT AS cluster, unit_idx AS row_id, time_idx AS col_id, (value IS NOT NULL)::INT AS seen FROM du CROSS JOIN dt LEFT JOIN coo USING (unit_idx, time_idx))"""


@query(f"""WITH {MASK}, b0 AS (SELECT cluster FROM mk GROUP BY 1 HAVING avg(seen) >= 0.2), m0 AS (SELECT mk.* FROM mk JOIN b0 USING (cluster)),
b1 AS (SELECT cluster, col_id FROM m0 GROUP BY 1, 2 HAVING avg(seen) > 0.88), m1 AS (SELECT m0.* FROM m0 JOIN b1 USING (cluster, col_id)),
b2 AS (SELECT cluster, row_id FROM m1 GROUP BY 1, 2 HAVING avg(seen) > 0.7), m2 AS (SELECT m1.* FROM m1 JOIN b2 USING (cluster, row_id))
SELECT cluster, count(DISTINCT row_id)::BIGINT AS n_rows, count(DISTINCT col_id)::BIGINT AS n_cols, round(avg(seen), 6) AS density FROM m2 GROUP BY 1 HAVING avg(seen) >= 0.9""")
def block_filter_two_pass(spark, sf_dir):
    p = events_daily(spark, sf_dir).persist()
    u, t, a = dims(p)
    seen = panel.encode(p, u, t, a).select("unit_idx", "time_idx", F.lit(1).alias("seen"))
    mask = panel.grid(u.select("unit_idx"), t.select("time_idx")).join(seen, ["unit_idx", "time_idx"], "left")
    mask = mask.select((F.col("unit_idx") % 4 * 5 + F.col("time_idx") % 5).cast("int").alias("cluster"), F.col("unit_idx").alias("row_id"), F.col("time_idx").alias("col_id"), F.coalesce("seen", F.lit(0)).alias("seen"))
    d = bicluster.block_filter(mask, 0.7, 0.88, 0.9)
    return d.groupBy("cluster").agg(F.countDistinct("row_id").alias("n_rows"), F.countDistinct("col_id").alias("n_cols"), F.round(F.avg("seen"), 6).alias("density"))


@query(f"""WITH {MATRIX}, cr AS (SELECT DISTINCT (row_id % 4)::INT AS cluster, row_id FROM x), cc AS (SELECT DISTINCT (col_id % 4)::INT AS cluster, col_id FROM x),
g AS (SELECT r.row_id, c.col_id FROM (SELECT DISTINCT row_id FROM x) r CROSS JOIN (SELECT DISTINCT col_id FROM x) c WHERE (r.row_id, c.col_id) NOT IN (SELECT (row_id, col_id) FROM x)),
br AS (SELECT cluster, col_id, count(*) AS r FROM x JOIN cr USING (row_id) GROUP BY 1, 2), bc AS (SELECT cluster, row_id, count(*) AS c FROM x JOIN cc USING (col_id) GROUP BY 1, 2),
sc AS (SELECT row_id, col_id, cluster, r * c AS score, row_number() OVER (PARTITION BY row_id, col_id ORDER BY r * c DESC, cluster) AS rank FROM g JOIN br USING (col_id) JOIN bc USING (row_id, cluster) WHERE r * c >= 9)
SELECT row_id, col_id, cluster, score::BIGINT AS score, rank::INT AS rank FROM sc WHERE rank <= 3""")
def cluster_match_topk(spark, sf_dir):
    x = matrix(spark, sf_dir).persist()
    grid = x.select("row_id").distinct().crossJoin(F.broadcast(x.select("col_id").distinct()))
    rows, cols = (x.select((F.col(c) % 4).cast("int").alias("cluster"), c).distinct() for c in ("row_id", "col_id"))
    return bicluster.match_clusters(panel.missing_cells(grid, x), x, rows, cols)


# ---------------------------------------------------------------- factors

FACT = "CAST(unit_idx % 7 + 1 AS DOUBLE) AS u1, CAST(unit_idx % 3 + 1 AS DOUBLE) AS u2, CAST(time_idx % 5 + 1 AS DOUBLE) AS t1, CAST(time_idx % 4 + 1 AS DOUBLE) AS t2, CAST(action_idx + 1 AS DOUBLE) AS a1, CAST(action_idx % 2 + 1 AS DOUBLE) AS a2"


def factors(c: DataFrame) -> DataFrame:
    """Fixed rank-two factors of all indices of a tensor."""
    vec = lambda x, p, q, plus=1: F.array((F.col(x) % p + 1).cast("double"), (F.col(x) % q + 1).cast("double"))
    out = [c.select(F.lit(m).alias("mode"), F.col(f"{m}_idx").alias("idx")).distinct().withColumn("vec", vec("idx", p, q)) for m, p, q in (("unit", 7, 3), ("time", 5, 4), ("action", 1000, 2))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {COO}, f AS (SELECT *, {FACT} FROM coo) SELECT time_idx, round(sum(u1*a1*u1*a1), 4) AS g11, round(sum(u1*a1*u2*a2), 4) AS g12, round(sum(u2*a2*u2*a2), 4) AS g22, round(sum(u1*a1*value), 4) AS b1, round(sum(u2*a2*value), 4) AS b2 FROM f GROUP BY 1")
def gram_time(spark, sf_dir):
    return _gram(spark, sf_dir, "time")


@query(f"WITH {COO}, f AS (SELECT *, {FACT} FROM coo) SELECT unit_idx, round(sum(t1*a1*t1*a1), 4) AS g11, round(sum(t1*a1*t2*a2), 4) AS g12, round(sum(t2*a2*t2*a2), 4) AS g22, round(sum(t1*a1*value), 4) AS b1, round(sum(t2*a2*value), 4) AS b2 FROM f GROUP BY 1")
def gram_unit(spark, sf_dir):
    return _gram(spark, sf_dir, "unit")


def _gram(spark, sf_dir, mode):
    c = coo(spark, sf_dir).persist()
    f = factors(c)
    g = cp.normal_equations(c, mode, {m: f.where(F.col("mode") == m).select("idx", "vec") for m in cp.MODES if m != mode}, 2)
    r = lambda c, k, n: F.round(F.col(c)[k], 4).alias(n)
    return g.select(F.col("idx").alias(f"{mode}_idx"), r("gram", 0, "g11"), r("gram", 1, "g12"), r("gram", 2, "g22"), r("side", 0, "b1"), r("side", 1, "b2"))


@query(f"WITH {COO}, f AS (SELECT *, {FACT} FROM coo) SELECT time_idx, round(sum(u1*a1*value) / sum(u1*a1*u1*a1), 6) AS factor FROM f GROUP BY 1")
def cp_rank1_step(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    f = factors(c).withColumn("vec", F.slice("vec", 1, 1))
    return cp.new_time_factors(c, f, 1).select(F.col("idx").alias("time_idx"), F.round(F.col("vec")[0], 6).alias("factor"))


@query(f"WITH {COO}, f AS (SELECT *, {FACT} FROM coo) SELECT unit_idx, time_idx, action_idx, u1*t1*a1 + u2*t2*a2 AS fitted FROM f")
def cp_evaluate(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    return cp.evaluate(c.select("unit_idx", "time_idx", "action_idx"), factors(c), "fitted")


@query(f"WITH {COO}, f AS (SELECT unit_idx, action_idx, {FACT.replace('time_idx', '0')} FROM du CROSS JOIN da), n AS (SELECT count(*) AS n FROM du) SELECT (action_idx * n + unit_idx)::INT AS row_id, u1*a1 AS w1, u2*a2 AS w2 FROM f CROSS JOIN n")
def merge_factors(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    f = factors(c)
    u, a = cp.of_mode(f, "unit", "vec"), cp.of_mode(f, "action", "vec")
    return layout.merge_factors(u, a, u.count()).select("row_id", F.col("vec")[0].alias("w1"), F.col("vec")[1].alias("w2"))


@query(f"WITH {COO}, f AS (SELECT *, {FACT} FROM coo) SELECT round(2 * avg((u1*t1*a1 + u2*t2*a2 - value) * (u1*t1*a1 + u2*t2*a2 - value)) / avg(value * value), 6) AS mean_drift FROM f")
def mean_drift(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    return cp.mean_drift(c, factors(c)).select(F.round("mean_drift", 6).alias("mean_drift"))


# ---------------------------------------------------------------- counterfactual reading


@query(f"""WITH {COO}, w AS (SELECT unit_idx, time_idx, CASE WHEN time BETWEEN DATE '2024-01-12' AND DATE '2024-01-18' THEN (SELECT action_idx FROM da WHERE action = 'click') ELSE action_idx END AS action_idx, unit, time
  FROM (SELECT du.unit, dt.time, unit_idx, time_idx FROM du CROSS JOIN dt WHERE time BETWEEN DATE '2024-01-10' AND DATE '2024-01-20') g LEFT JOIN coo USING (unit_idx, time_idx)), f AS (SELECT *, {FACT} FROM w)
SELECT f.unit, f.time, da.action, u1*t1*a1 + u2*t2*a2 AS value FROM f LEFT JOIN da USING (action_idx)""")
def counterfactual_query(spark, sf_dir):
    m = _table_model(spark, sf_dir)
    return m.query(None, ("2024-01-10", "2024-01-20"), "metric", "click", ("2024-01-12", "2024-01-18")).select("unit", "time", "action", "value")


def _table_model(spark, sf_dir) -> PanelModel:
    """A model over the events panel whose factors are fixed, with one regime and no mask."""
    p = events_daily(spark, sf_dir).persist()
    u, t, a = dims(p)
    m = PanelModel(spark, ModelConfig(imputer="none", cp=CpConfig(rank=2)))
    m.spec = PanelSpec("unit", "time", ("action",), "metric")
    e = panel.encode(p, u, t, a).persist()
    m.tables = {"units": u, "times": t, "actions": a, "assignment": panel.assignment(e), "obs": panel.observed(e)}
    m.tables["factors"] = factors(m.tables["obs"]).select(F.lit(0).alias("regime"), "mode", "idx", "vec")
    m.tables["nan_mask"] = spark.createDataFrame([], "unit_idx int, time_idx int, action_idx int")
    m.tables["regimes"] = spark.createDataFrame([(0, 0, None, 0.1, DAYS)], drift.REGIMES)
    m.tables["drift"] = spark.createDataFrame([], "time_idx int, distance_error double, cusum double")
    m.counts = {"T": DAYS, "I": ACTIONS}
    return m


@query(f"WITH {COO}, g AS (SELECT unit, time, action, unit_idx, time_idx, action_idx FROM du CROSS JOIN dt CROSS JOIN da), f AS (SELECT *, {FACT} FROM g) SELECT unit, f.time, f.action, u1*t1*a1 + u2*t2*a2 AS value, coo.value IS NOT NULL AS observed FROM f LEFT JOIN coo USING (unit_idx, time_idx, action_idx)")
def all_counterfactuals(spark, sf_dir):
    return _table_model(spark, sf_dir).counterfactuals()


@query(f"""WITH {COO} SELECT du.unit, dt.time, CASE WHEN time_idx BETWEEN 10 AND 16 THEN 'view' ELSE da.action END AS action
FROM du CROSS JOIN dt LEFT JOIN coo USING (unit_idx, time_idx) LEFT JOIN da USING (action_idx)""")
def override_assignment(spark, sf_dir):
    return _table_model(spark, sf_dir).query(None, None, "metric", "view", ("2024-01-11", "2024-01-17")).select("unit", "time", "action")


@query(f"""WITH {COO}, g AS (SELECT unit, time, action, unit_idx, time_idx, action_idx FROM du CROSS JOIN dt CROSS JOIN da), f AS (SELECT *, {FACT} FROM g)
SELECT unit, f.time, f.action, CASE WHEN (unit_idx + time_idx) % 5 = 0 AND action_idx = 1 THEN NULL WHEN time_idx < 10 THEN u1*t1*a1 + u2*t2*a2 WHEN time_idx < 20 THEN 2*u1*t1*a1 ELSE u1*t1*a1 - u2*t2*a2 END AS value FROM f""")
def counterfactuals_of_regimes(spark, sf_dir):
    """Three regimes with factors of their own, and masked cells."""
    m = _table_model(spark, sf_dir)
    m.tables["regimes"] = spark.createDataFrame([(0, 0, 9, 0.1, DAYS), (1, 10, 19, 0.1, DAYS), (2, 20, None, 0.1, DAYS)], drift.REGIMES)
    f, v = m.tables["factors"].drop("regime"), F.col("vec")
    of = lambda k, second: f.select(F.lit(k).alias("regime"), "mode", "idx", F.when(F.col("mode") == "action", F.array(v[0] * (2 if k == 1 else 1), v[1] * second)).otherwise(v).alias("vec"))
    m.tables["factors"] = of(0, 1).unionByName(of(1, 0)).unionByName(of(2, -1))
    mask = m.tables["units"].select("unit_idx").crossJoin(F.broadcast(m.tables["times"].select("time_idx"))).where((F.col("unit_idx") + F.col("time_idx")) % 5 == 0)  # time steps
    m.tables["nan_mask"] = mask.withColumn("action_idx", F.lit(1))
    return m.counterfactuals().drop("observed")


REG = "reg AS (SELECT * FROM (VALUES (0, 0, 9), (1, 10, 19), (2, 20, NULL)) v(regime, start_t, end_t))"


def three_regimes(spark):
    return spark.createDataFrame([(0, 0, 9), (1, 10, 19), (2, 20, None)], "regime int, start_t int, end_t int")


@query(f"WITH {COO}, {REG} SELECT unit_idx, time_idx, regime, (time_idx - start_t)::INT AS local_idx FROM coo JOIN reg ON time_idx BETWEEN start_t AND coalesce(end_t, 2147483647)")
def regime_range_join(spark, sf_dir):
    return drift.regime_of(coo(spark, sf_dir), three_regimes(spark)).select("unit_idx", "time_idx", "regime", (F.col("time_idx") - F.col("start_t")).alias("local_idx"))


@query(f"WITH {P2} SELECT unit, " + ", ".join(f"max(metric) FILTER (month(time) = {k} AND year(time) = 1996) AS m{k}" for k in range(1, 13)) + " FROM p2 GROUP BY unit")
def wide_output(spark, sf_dir):
    p = nation_monthly(spark, sf_dir).withColumn("k", F.when(F.year("time") == 1996, F.concat(F.lit("m"), F.month("time").cast("string"))))
    return panel.to_wide(p.select("unit", F.col("k").alias("time"), F.col("metric").alias("value")), times=[f"m{k}" for k in range(1, 13)])


# ---------------------------------------------------------------- series


@query(f"WITH {SERIES} SELECT round(sum(a.value * b.value) / sum(b.value * b.value), 6) AS phi FROM s a JOIN s b ON a.t = b.t + 1")
def ar1_fit(spark, sf_dir):
    return mssa.fit_autoregression(_one_series(spark, sf_dir), 1).select(F.round(F.col("phi")[0], 6).alias("phi"))


def _one_series(spark, sf_dir):
    return daily_series(spark, sf_dir).select(F.lit(0).alias("factor"), "t", "value")


@query(f"""WITH {SERIES}, d AS (SELECT a.value AS y, b.value AS x1, c.value AS x2 FROM s a JOIN s b ON a.t = b.t + 1 JOIN s c ON a.t = c.t + 2),
n AS (SELECT sum(x1*x1) AS a, sum(x1*x2) AS b, sum(x2*x2) AS c, sum(x1*y) AS p, sum(x2*y) AS q FROM d) SELECT round((p*c - q*b) / (a*c - b*b), 5) AS phi1, round((q*a - p*b) / (a*c - b*b), 5) AS phi2 FROM n""")
def ar2_fit(spark, sf_dir):
    return mssa.fit_autoregression(_one_series(spark, sf_dir), 2).select(F.round(F.col("phi")[0], 5).alias("phi1"), F.round(F.col("phi")[1], 5).alias("phi2"))


@query(f"WITH {SERIES}, p AS (SELECT sum(a.value * b.value) / sum(b.value * b.value) AS phi FROM s a JOIN s b ON a.t = b.t + 1), l AS (SELECT value FROM s ORDER BY t DESC LIMIT 1) SELECT h::INT AS step, round(value * pow(phi, h), 4) AS value FROM p CROSS JOIN l CROSS JOIN range(1, 6) r(h)")
def ar1_forecast(spark, sf_dir):
    return mssa.forecast_autoregression(_one_series(spark, sf_dir), 1, 5).select("step", F.round("value", 4).alias("value"))


# ---------------------------------------------------------------- drift

DIST = COO + f", f AS (SELECT *, {FACT} FROM coo), dd AS (SELECT time_idx, round(avg((20*u1 - value) * (20*u1 - value)) / avg(value * value), 8) AS distance_error FROM f GROUP BY 1)"
CUS = DIST + ", s1 AS (SELECT time_idx, distance_error, sum(distance_error - 0.4) OVER (ORDER BY time_idx) AS s FROM dd), cs AS (SELECT time_idx, distance_error, s - least(0, min(s) OVER (ORDER BY time_idx)) AS cusum FROM s1)"


def _distances(spark, sf_dir):
    c = coo(spark, sf_dir).withColumn("fitted", 20.0 * (F.col("unit_idx") % 7 + 1))
    return drift.distance(c).withColumn("distance_error", F.round("distance_error", 8))


@query(f"WITH {DIST} SELECT time_idx, round(distance_error, 6) AS distance_error FROM dd")
def drift_distance(spark, sf_dir):
    return _distances(spark, sf_dir).withColumn("distance_error", F.round("distance_error", 6))


@query(f"WITH {CUS} SELECT time_idx, round(cusum, 6) AS cusum FROM cs")
def cusum(spark, sf_dir):
    return drift.cusum(_distances(spark, sf_dir), 0.4).select("time_idx", F.round("cusum", 6).alias("cusum"))


@query(f"WITH {CUS} SELECT min(time_idx) FILTER (cusum > 0.05)::INT AS shift_time FROM cs WHERE time_idx >= 3")
def shift_time(spark, sf_dir):
    return drift.shift_time(drift.cusum(_distances(spark, sf_dir), 0.4), 0.05, 3)


@query("SELECT * FROM (VALUES (0, 0, 9), (1, 10, 19), (2, 20, 24), (3, 25, NULL)) v(regime, start_t, end_t)")
def regime_split(spark, sf_dir):
    return drift.split_regime(three_regimes(spark), 25)


# ---------------------------------------------------------------- effects


@query(f"WITH {P1}, m AS (SELECT action, avg(metric) AS m FROM p1 GROUP BY 1) SELECT m.action, round(m.m - b.m, 6) AS effect FROM m JOIN m b ON b.action = 'view' WHERE m.action <> 'view'")
def naive_ate(spark, sf_dir):
    return _rounded(estimands.naive_ate(events_daily(spark, sf_dir), "view"), "effect")


def _rounded(d: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return d.withColumns({c: F.round(c, digits) for c in columns})


@query(f"WITH {P1} SELECT action, count(metric)::BIGINT AS n, round(avg(metric), 6) AS mean_metric FROM p1 GROUP BY 1")
def group_means(spark, sf_dir):
    return _rounded(estimands.group_means(events_daily(spark, sf_dir)), "mean_metric")


@query(f"WITH {CF} SELECT a.action, round(avg(a.value - b.value), 5) AS effect FROM cf a JOIN cf b USING (unit, time) WHERE b.action = 'view' AND a.action <> 'view' GROUP BY 1")
def ate_overall(spark, sf_dir):
    return _rounded(estimands.ate(ratio_counterfactuals(spark, sf_dir), "view"), "effect", digits=5)


@query(f"WITH {CF} SELECT time, a.action, round(avg(a.value - b.value), 5) AS effect FROM cf a JOIN cf b USING (unit, time) WHERE b.action = 'view' AND a.action <> 'view' GROUP BY ALL")
def ate_by_time(spark, sf_dir):
    return _rounded(estimands.ate_by_time(ratio_counterfactuals(spark, sf_dir), "view"), "effect", digits=5)


SEG = ", seg AS (SELECT DISTINCT unit, (unit % 4)::INT AS segment, (unit % 3)::INT AS tier FROM p1)"


def _segments(spark, sf_dir):
    return events_daily(spark, sf_dir).select("unit").distinct().select("unit", (F.col("unit") % 4).cast("int").alias("segment"), (F.col("unit") % 3).cast("int").alias("tier"))


@query(f"WITH {CF}{SEG} SELECT segment, a.action, round(avg(a.value - b.value), 5) AS effect FROM cf a JOIN cf b USING (unit, time) JOIN seg USING (unit) WHERE b.action = 'view' AND a.action <> 'view' GROUP BY ALL")
def cate_by_segment(spark, sf_dir):
    return _rounded(estimands.cate(ratio_counterfactuals(spark, sf_dir), _segments(spark, sf_dir), ["segment"], "view"), "effect", digits=5)


@query(f"WITH {CF}{SEG} SELECT segment, tier, action, round(avg(diff), 5) AS effect FROM (SELECT segment, tier, a.action, a.value - b.value AS diff FROM cf a JOIN cf b USING (unit, time) JOIN seg USING (unit) WHERE b.action = 'view' AND a.action <> 'view') GROUP BY CUBE (segment, tier, action) HAVING action IS NOT NULL")
def cate_cube(spark, sf_dir):
    return _rounded(estimands.cate_cube(ratio_counterfactuals(spark, sf_dir), _segments(spark, sf_dir), ["segment", "tier"], "view"), "effect", digits=5)


IPW = "c AS (SELECT {by}segment, region, action, count(metric) AS n, sum(metric) AS total FROM p3 GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY {by}segment, region)::DOUBLE / n AS w FROM c), o AS (SELECT {by}action, sum(w * total) / sum(w * n) AS outcome FROM w GROUP BY ALL)"


@query(f"WITH {P3}, {IPW.format(by='')} SELECT o.action, round(o.outcome, 4) AS outcome, round(o.outcome - b.outcome, 4) AS effect FROM o JOIN o b ON b.action = '5-LOW' WHERE o.action <> '5-LOW'")
def ipw_saturated(spark, sf_dir):
    return _rounded(estimands.ipw_saturated(customer_orders(spark, sf_dir), ["segment", "region"], "5-LOW"), "outcome", "effect", digits=4)


@query(f"WITH {P3.replace('CAST(o_orderdate AS DATE)', 'year(o_orderdate)::INT')}, {IPW.format(by='time, ')} SELECT time, o.action, round(o.outcome, 4) AS outcome, round(o.outcome - b.outcome, 4) AS effect FROM o JOIN o b USING (time) WHERE b.action = '5-LOW' AND o.action <> '5-LOW'")
def ipw_by_time(spark, sf_dir):
    p = customer_orders(spark, sf_dir).withColumn("time", F.year("time"))
    return _rounded(estimands.ipw_saturated(p, ["segment", "region"], "5-LOW", ["time"]), "outcome", "effect", digits=4)


@query(f"WITH {P3}, c AS (SELECT segment, region::INT AS region, action, avg(metric) AS outcome FROM p3 GROUP BY ALL) SELECT c.segment, c.region, c.action, round(c.outcome - b.outcome, 4) AS effect FROM c JOIN c b USING (segment, region) WHERE b.action = '5-LOW' AND c.action <> '5-LOW'")
def dr_saturated(spark, sf_dir):
    p = customer_orders(spark, sf_dir).withColumn("region", F.col("region").cast("int"))
    return _rounded(estimands.dr_saturated(p, ["segment", "region"], "5-LOW"), "effect", digits=4)


@query(f"WITH {CF}, n AS (SELECT action, avg(metric) AS m FROM p1 GROUP BY 1), e AS (SELECT a.action, avg(a.value - b.value) AS effect FROM cf a JOIN cf b USING (unit, time) WHERE b.action = 'view' AND a.action <> 'view' GROUP BY 1) SELECT e.action, round(abs(e.effect - (n.m - b.m)), 4) AS abs_error FROM e JOIN n USING (action) JOIN n b ON b.action = 'view'")
def abs_error(spark, sf_dir):
    e = estimands.absolute_errors(estimands.ate(ratio_counterfactuals(spark, sf_dir), "view"), estimands.naive_ate(events_daily(spark, sf_dir), "view"), ["action"])
    return _rounded(e, "abs_error", digits=4)


FIT = CF + ", ft AS (SELECT metric, value FROM p1 JOIN cf USING (unit, time, action))"


def _fitted(spark, sf_dir):
    return events_daily(spark, sf_dir).join(ratio_counterfactuals(spark, sf_dir), ["unit", "time", "action"])


@query(f"WITH {FIT} SELECT round(100 * avg(abs(metric - value)) / avg(metric), 6) AS mape FROM ft")
def mape(spark, sf_dir):
    return _rounded(metrics.mape(_fitted(spark, sf_dir), "metric", "value"), "mape")


@query(f"WITH {FIT} SELECT round(avg((metric - value) * (metric - value)), 4) AS mse, round(sqrt(avg((metric - value) * (metric - value))), 6) AS rmse, round(1 - sum((metric - value) * (metric - value)) / (count(*) * var_pop(metric)), 6) AS r2, count(*)::BIGINT AS n_estimated FROM ft")
def accuracy(spark, sf_dir):
    return _rounded(_rounded(metrics.accuracy(_fitted(spark, sf_dir), "metric", "value"), "rmse", "r2"), "mse", digits=4)


# ---------------------------------------------------------------- generator

SYN = COO + ", y AS (SELECT unit_idx, time_idx, g.a::INT AS action_idx, CAST((unit_idx * 7 + time_idx * 3 + g.a * 11) % 23 AS DOUBLE) AS value FROM du CROSS JOIN dt CROSS JOIN range(3) g(a))"


def _integer_truth(spark, sf_dir):
    """A truth over the events panel's units and days from integer arithmetic."""
    p = events_daily(spark, sf_dir).persist()
    u, t, _ = dims(p)
    cells = u.select("unit_idx").crossJoin(F.broadcast(t.select("time_idx"))).crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("action_idx"))))
    return cells.withColumn("value", ((F.col("unit_idx") * 7 + F.col("time_idx") * 3 + F.col("action_idx") * 11) % 23).cast("double"))


@query(f"""WITH {SYN}, z AS (SELECT *, avg(value) FILTER (action_idx = 0) OVER (PARTITION BY time_idx, unit_idx % 2) AS c, avg(value) FILTER (action_idx = 1) OVER (PARTITION BY time_idx, unit_idx % 2) AS m FROM y)
SELECT unit_idx, time_idx, action_idx, round(CASE WHEN action_idx = 1 AND unit_idx % 2 = 0 THEN value + 0.25 * c - (m - c) ELSE value END, 6) AS value FROM z""")
def synth_effect_shift(spark, sf_dir):
    return _rounded(synth.shifted_effect(_integer_truth(spark, sf_dir), 1, 0.25, "unit_idx % 2 = 0"), "value")


@query(f"WITH {SYN} SELECT unit_idx, time_idx, least(greatest(10 + sum(value) OVER (PARTITION BY unit_idx ORDER BY time_idx ROWS UNBOUNDED PRECEDING), 20.0), 300.0) AS level FROM y WHERE action_idx = 0")
def difference_metric_cumsum(spark, sf_dir):
    d = _integer_truth(spark, sf_dir).where("action_idx = 0")
    return synth.sample_metric(d, synth.Metric("level", 20.0, 300.0, True, 10.0)).select("unit_idx", "time_idx", "level")


@query(f"WITH {SYN} SELECT unit_idx, time_idx FROM y WHERE action_idx = 0 AND time_idx < 8 + unit_idx % 22")
def tail_mask(spark, sf_dir):
    return _integer_truth(spark, sf_dir).where("action_idx = 0").where(synth.before_tail(8 + F.col("unit_idx") % 22)).select("unit_idx", "time_idx")


@query(f"WITH {SYN} SELECT unit_idx, time_idx, " + ", ".join(f"max(value) FILTER (action_idx = {i}) AS sales_change_{i}" for i in range(3)) + " FROM y GROUP BY 1, 2")
def metric_columns_by_action(spark, sf_dir):
    return synth.metric_columns(_integer_truth(spark, sf_dir), synth.Metric("sales", None, None, True, 10.0), 3)


@query(f"WITH {SYN} SELECT unit_idx, time_idx, action_idx, value FROM y WHERE action_idx = CASE WHEN time_idx < 15 THEN 0 WHEN unit_idx % 3 = 1 THEN 1 WHEN unit_idx % 3 = 2 THEN 2 ELSE 0 END")
def period_policy(spark, sf_dir):
    periods = synth.si_scenario(DAYS, 3, ["unit_idx % 3 = 0", "unit_idx % 3 = 1", "unit_idx % 3 = 2"])
    return synth.auto_subsample(_integer_truth(spark, sf_dir), periods, DAYS, 3)


# ---------------------------------------------------------------- fitted algorithms on tables of rank one, whose answer SQL knows

#: Truth of rank one: units, steps (growing by a hundredth) and actions, without the constant that scales it.
ONE = "(10 + unit_idx % 7) * pow(1.0137139, time_idx) * (1 + 0.1 * action_idx)"
TRUTH = COO + f", truth AS (SELECT unit, time, action, unit_idx, time_idx, action_idx, {ONE} AS value FROM du CROSS JOIN dt CROSS JOIN da)"


def _one(name: str = "value") -> Column:
    return ((10 + F.col("unit_idx") % 7) * F.pow(F.lit(1.0137139), F.col("time_idx")) * (1 + 0.1 * F.col("action_idx"))).alias(name)


def _rank_one_panel(spark, sf_dir) -> DataFrame:
    """(unit, time, action, metric): the events panel's units, days and actions with a metric of rank one."""
    p = events_daily(spark, sf_dir).persist()
    u, t, a = dims(p)
    d = p.join(u, "unit").join(t, "time").join(a, "action")
    return d.select("unit", "time", "action", _one("metric"))


def _block_matrix(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(cells, missing): units by days of rank one, where every fourth unit lacks the days from the 20th on."""
    p = events_daily(spark, sf_dir).persist()
    u, t, _ = dims(p)
    grid = u.select("unit_idx").crossJoin(F.broadcast(t.select("time_idx"))).withColumn("action_idx", F.lit(0))  # time steps
    d = grid.select(F.col("unit_idx").alias("row_id"), F.col("time_idx").alias("col_id"), _one()).persist()
    gone = (F.col("row_id") % 4 == 0) & (F.col("col_id") >= 20)
    return d.where(~gone), d.where(gone).select("row_id", "col_id")


BLOCK = f"WITH {COO} SELECT unit_idx AS row_id, time_idx AS col_id, round((10 + unit_idx % 7) * pow(1.0137139, time_idx), 4) AS value, true AS feasible, true AS exact FROM du CROSS JOIN dt WHERE unit_idx % 4 = 0 AND time_idx >= 20"


@query(BLOCK)
def snn_of_rank_one(spark, sf_dir):
    return _rounded(snn.snn_impute(*_block_matrix(spark, sf_dir), SnnConfig(n_neighbors=2, max_rank=1)), "value", digits=4)


@query(BLOCK)
def als_of_rank_one(spark, sf_dir):
    return _rounded(bicluster.als_impute(*_block_matrix(spark, sf_dir), AlsConfig(ranks=(1,), ridge=1e-12)), "value", digits=4)


@query(BLOCK)
def als_of_rank_one_distributed(spark, sf_dir):
    return _rounded(bicluster.als_impute(*_block_matrix(spark, sf_dir), AlsConfig(ranks=(1,), ridge=1e-12, driver_cells=0)), "value", digits=4)


@query(BLOCK.replace("time_idx), 4)", "time_idx), 3)"))
def bicluster_of_rank_one(spark, sf_dir):
    return _rounded(bicluster.bicluster_impute(*_block_matrix(spark, sf_dir), BiclusterConfig(rank=1)), "value", digits=3)


@query(f"WITH {TRUTH} SELECT unit_idx, time_idx, action_idx, round(value, 4) AS value FROM truth")
def cp_of_rank_one(spark, sf_dir):
    """A fit of the cells that were seen, evaluated everywhere."""
    c = coo(spark, sf_dir).select("unit_idx", "time_idx", "action_idx", _one()).persist()
    shape = tuple(c.agg(F.max(f"{m}_idx")).first()[0] + 1 for m in cp.MODES)
    factors = cp.fit_cp(spark, c, CpConfig(rank=1, ridge=1e-13, tolerance=1e-13), shape)
    return _rounded(cp.evaluate(_integer_grid(spark, sf_dir), factors), "value", digits=4)


def _integer_grid(spark, sf_dir) -> DataFrame:
    u, t, a = dims(events_daily(spark, sf_dir).persist())
    return panel.grid(u.select("unit_idx"), t.select("time_idx"), a.select("action_idx"))


@query("SELECT f::INT AS factor, (h - 1)::INT AS step, round((f + 1) * pow(1.05, 23 + h), 4) AS value FROM range(3) a(f) CROSS JOIN range(1, 6) b(h)")
def mssa_of_rank_one(spark, sf_dir):
    s = spark.range(72).select((F.col("id") % 3).cast("int").alias("factor"), F.floor(F.col("id") / 3).cast("int").alias("t")).withColumn("value", (F.col("factor") + 1) * F.pow(F.lit(1.05), F.col("t")))
    cfg = MssaConfig(lags=5, rank=1)
    return _rounded(mssa.forecast_series(s, mssa.fit_forecasters(s, cfg), 5, cfg), "value", digits=4)


RANK_ONE = ModelConfig(imputer="none", cp=CpConfig(rank=1, ridge=1e-13, tolerance=1e-13), mssa=MssaConfig(lags=5, rank=1), full_training_time_steps=10)


def _rank_one_model(spark, sf_dir, until: str = "2024-02-01") -> PanelModel:
    p = _rank_one_panel(spark, sf_dir).persist()
    m = PanelModel(spark, RANK_ONE).fit(p.where(F.col("time") < until), PanelSpec("unit", "time", ("action",), "metric"))
    return m.partial_fit(p.where(F.col("time") >= until)) if until < "2024-02-01" else m


@query(f"""WITH {TRUTH} SELECT t.unit, t.time, t.action, round(t.value, 3) AS value, coo.value IS NOT NULL AS observed FROM truth t LEFT JOIN coo USING (unit_idx, time_idx, action_idx)
WHERE t.time BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND t.action = 'purchase'""")
def model_query_of_rank_one(spark, sf_dir):
    return _rounded(_rank_one_model(spark, sf_dir).query(None, ("2024-01-10", "2024-01-20"), "metric", "purchase").drop("pos"), "value", digits=3)


@query(f"""WITH {TRUTH}, n AS (SELECT count(*) AS steps FROM dt) SELECT unit, (steps + h)::INT AS step, action, round((10 + unit_idx % 7) * pow(1.0137139, steps + h) * (1 + 0.1 * action_idx), 3) AS value
FROM (SELECT DISTINCT unit, unit_idx, action, action_idx FROM truth WHERE action = 'view') CROSS JOIN n CROSS JOIN range(4) r(h)""")
def model_forecast_of_rank_one(spark, sf_dir):
    return _rounded(_rank_one_model(spark, sf_dir).forecast(None, 4, "metric", "view").drop("pos"), "value", digits=3)


@query(f"WITH {TRUTH} SELECT unit, time, action, round(value, 3) AS value FROM truth")
def partial_fit_of_rank_one(spark, sf_dir):
    """Twenty-four days fitted, the rest appended: all counterfactuals."""
    return _rounded(_rank_one_model(spark, sf_dir, "2024-01-25").counterfactuals().drop("observed"), "value", digits=3)


@query(f"""WITH {TRUTH}, n AS (SELECT count(*) AS steps FROM dt) SELECT unit, (steps + h)::INT AS step, round((10 + unit_idx % 7) * pow(1.0137139, steps + h), 3) AS value
FROM (SELECT DISTINCT unit, unit_idx FROM truth) CROSS JOIN n CROSS JOIN range(3) r(h)""")
def forecast_after_append(spark, sf_dir):
    """Forecasters keep their coefficients over an append and go on from the longer history."""
    return _rounded(_rank_one_model(spark, sf_dir, "2024-01-25").forecast(None, 3, "metric", "click").select("unit", "step", "value"), "value", digits=3)


# ---------------------------------------------------------------- sets of rows

HALVES = P1 + ", a AS (SELECT unit, action FROM p1 WHERE time < DATE '2024-01-16'), b AS (SELECT unit, action FROM p1 WHERE time >= DATE '2024-01-16')"


def _halves(spark, sf_dir):
    p = events_daily(spark, sf_dir).persist()
    return p.where("time < '2024-01-16'"), p.where("time >= '2024-01-16'")


@query(f"WITH {HALVES} SELECT * FROM a INTERSECT SELECT * FROM b")
def units_in_both(spark, sf_dir):
    return panel.in_both(*_halves(spark, sf_dir), "unit", "action")


@query(f"WITH {HALVES} SELECT * FROM a EXCEPT SELECT * FROM b")
def units_in_first_only(spark, sf_dir):
    return panel.in_first_only(*_halves(spark, sf_dir), "unit", "action")


@query()
def row_sample(spark, sf_dir):
    """A tenth of the panel's rows by a hash of their keys."""
    return panel.sample_rows(events_daily(spark, sf_dir), 0.1, ["unit", "time"])


# ---------------------------------------------------------------- fitted algorithms on the tables' own values (no SQL form)


def _orders_matrix(spark, sf_dir):
    p = nation_monthly(spark, sf_dir).persist()
    u, t, a = dims(p)
    n = t.count()
    x = layout.to_page(panel.observed(panel.encode(p, u, t, a)), n).select("row_id", "col_id", "value").persist()
    grid = layout.to_page(panel.grid(u.select("unit_idx"), t.select("time_idx"), a.select("action_idx")), n).select("row_id", "col_id")
    return x, panel.missing_cells(grid, x)


@query()
def snn_events(spark, sf_dir):
    """The events panel's units by days, where a day without events is missing: grows with the tables."""
    p = events_daily(spark, sf_dir).persist()
    u, t, _ = dims(p)
    cells = p.join(u, "unit").join(t, "time").select(F.col("unit_idx").alias("row_id"), F.col("time_idx").alias("col_id"), F.col("metric").alias("value")).persist()
    grid = panel.grid(u.select(F.col("unit_idx").alias("row_id")), t.select(F.col("time_idx").alias("col_id")))
    return snn.snn_impute(cells, panel.missing_cells(grid, cells), SnnConfig(max_rank=3, node_budget=2000))


@query()
def snn_impute(spark, sf_dir):
    return snn.snn_impute(*_orders_matrix(spark, sf_dir), SnnConfig())


@query()
def snn_bicluster(spark, sf_dir):
    return bicluster.bicluster_impute(*_orders_matrix(spark, sf_dir), BiclusterConfig())


@query()
def als_impute(spark, sf_dir):
    return bicluster.als_impute(*_orders_matrix(spark, sf_dir), AlsConfig(sweeps=50))


@query()
def cp_als_fit(spark, sf_dir):
    c = coo(spark, sf_dir).persist()
    n = [c.agg(F.max(f"{m}_idx")).first()[0] + 1 for m in cp.MODES]
    return cp.fit_cp(spark, c, CpConfig(rank=3, sweeps=100), tuple(n))


@query()
def mssa_forecast(spark, sf_dir):
    s = daily_series(spark, sf_dir).select(F.lit(0).alias("factor"), "t", "value").persist()
    cfg = MssaConfig(lags=7)
    return mssa.forecast_series(s, mssa.fit_forecasters(s, cfg), 5, cfg)


SPEC = PanelSpec("unit", "time", ("action",), "metric")
SMALL = ModelConfig(imputer="als", cp=CpConfig(rank=3, sweeps=100), als=AlsConfig(ranks=(2, 3), sweeps=50), mssa=MssaConfig(lags=5))


@query()
def model_query(spark, sf_dir):
    m = PanelModel(spark, SMALL).fit(events_daily(spark, sf_dir), SPEC)
    return m.query(None, ("2024-01-10", "2024-01-20"), "metric", "purchase", ("2024-01-12", "2024-01-18"))


@query()
def model_forecast(spark, sf_dir):
    return PanelModel(spark, SMALL).fit(events_daily(spark, sf_dir), SPEC).forecast(None, 5, "metric", "purchase")


@query()
def partial_fit(spark, sf_dir):
    p = events_daily(spark, sf_dir).persist()
    m = PanelModel(spark, SMALL).fit(p.where("time < '2024-01-25'"), SPEC)
    return m.partial_fit(p.where("time >= '2024-01-25'")).diagnostics()


@query()
def ipw_logistic(spark, sf_dir):
    return estimands.ipw(customer_orders(spark, sf_dir), ["segment", "region"], "5-LOW")


@query()
def ipw_forest(spark, sf_dir):
    return estimands.ipw(customer_orders(spark, sf_dir), ["segment", "region"], "5-LOW", "forest")


@query()
def dr_forest(spark, sf_dir):
    return estimands.doubly_robust(customer_orders(spark, sf_dir), ["segment", "region"], "5-LOW")


@query()
def dr_linear(spark, sf_dir):
    return estimands.doubly_robust(customer_orders(spark, sf_dir), ["segment", "region"], "5-LOW", "linear")


@query()
def synthetic_panel(spark, sf_dir):
    g = synth.sales_scenario(n_units=30, n_times=24)
    truth = g.truth(spark)
    return g.stamped(synth.auto_subsample(truth, synth.random_scenario(24), 24, 3))
