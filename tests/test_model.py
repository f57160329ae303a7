import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import bicluster, estimands, metrics, panel, snn, synth
from panelloom.plans.model import PanelModel
from panelloom.sources import io
from panelloom.spec import AlsConfig, BiclusterConfig, CpConfig, ModelConfig, MssaConfig, PanelSpec, SnnConfig

SPEC = PanelSpec("unit", "time", ("action",), "metric")


def generated(spark, n, t, periods, seed=1, rank=2, **options):
    """(truth, panel) of a generator's run, both with string actions."""
    g = synth.Generator(n, t, 3, rank=rank, seed=seed, freq=None, **options)
    truth = g.truth(spark).persist()
    seen = synth.auto_subsample(truth, periods, t, 3, seed)
    names = [F.col("unit_idx").alias("unit"), F.col("time_idx").alias("time"), F.concat(F.lit("a"), F.col("action_idx")).alias("action")]
    return truth.select(*names, F.col("value").alias("truth")).persist(), seen.select(*names, F.col("value").alias("metric")).persist()


THIRDS = ["unit_idx % 3 = 0", "unit_idx % 3 = 1", "unit_idx % 3 = 2"]


def score(model, truth):
    both = model.counterfactuals().join(truth, ["unit", "time", "action"])
    return metrics.accuracy(both.where("not observed"), "truth", "value").first()


@pytest.mark.parametrize("imputer", ["snn", "als", "none"])
def test_imputers_recover_generated_truth(spark, imputer):
    periods = synth.si_scenario(24, 3, THIRDS) if imputer == "snn" else synth.random_scenario(24)
    truth, seen = generated(spark, 30, 24, periods)
    cfg = ModelConfig(imputer=imputer, snn=SnnConfig(max_rank=3), cp=CpConfig(rank=3, sweeps=400), als=AlsConfig(ranks=(2, 3), sweeps=300), mssa=MssaConfig(lags=5))
    model = PanelModel(spark, cfg).fit(seen, SPEC)
    found = score(model, truth)
    assert found["n_estimated"] > 0 and found["r2"] > 0.9
    assert (model.N, model.T, model.I) == (30, 24, 3) and "imputer" in repr(model)
    wide = model.to_wide(model.query([2, 1, 2], (3, 5), "metric", "a1"))
    assert sorted(wide.columns) == ["3", "4", "5", "unit"]


def test_bicluster_imputer_runs(spark):
    truth, seen = generated(spark, 24, 20, synth.si_scenario(20, 3, THIRDS))
    model = PanelModel(spark, ModelConfig(imputer="snn_bicluster", bicluster=BiclusterConfig(rank=3), cp=CpConfig(rank=3, sweeps=200), mssa=MssaConfig(lags=4))).fit(seen, SPEC)
    assert model.counterfactuals().count() == 24 * 20 * 3


def test_query_forecast_append_and_save(spark, tmp_path):
    truth, seen = generated(spark, 20, 30, synth.random_scenario(30))
    cfg = ModelConfig(imputer="none", cp=CpConfig(rank=3, sweeps=500), mssa=MssaConfig(lags=6), full_training_time_steps=10)
    model = PanelModel(spark, cfg).fit(seen.where("time < 24"), SPEC)
    q = model.query(None, (2, 8), "metric", "a1", (4, 5)).collect()
    taken = {(r["unit"], r["time"]): r["action"] for r in seen.collect()}
    assert len(q) == 140 and all(r["action"] == ("a1" if r["time"] in (4, 5) else taken[r["unit"], r["time"]]) for r in q)
    assert model.query(None, (90, 99), "metric", "a1").count() == 0
    with pytest.raises(KeyError):
        model.query([999], (2, 3), "metric", "a1").collect()
    with pytest.raises(ValueError):
        model.query(None, (2, 3), "other", "a1")
    f = model.forecast([3, 4], 4, "metric", "a2").collect()
    assert sorted({r["step"] for r in f}) == [24, 25, 26, 27] and all(np.isfinite(r["value"]) for r in f)
    model.save(f"file://{tmp_path}/m")
    for again in (PanelModel.load(spark, f"file://{tmp_path}/m"), PanelModel.from_bytes(spark, model.to_bytes())):
        assert again.config == model.config
        assert sorted(map(tuple, again.query(None, (2, 8), "metric", "a1").collect())) == sorted(map(tuple, model.query(None, (2, 8), "metric", "a1").collect()))
    model.partial_fit(seen.where("time >= 22"))
    assert model.T == 30 and model.late.count() == 40 and model.summary().count() == 1
    assert score(model, truth)["r2"] > 0.9
    with pytest.raises(ValueError):
        model.partial_fit(spark.createDataFrame([(999, 40, "a1", 1.0)], "unit int, time int, action string, metric double"))
    assert model.diagnostics().count() == 30


def test_drift_opens_a_regime(spark):
    truth, seen = generated(spark, 20, 40, synth.random_scenario(40), regimes=(30,), high=10.0)
    cfg = ModelConfig(imputer="none", cp=CpConfig(rank=3, sweeps=300), mssa=MssaConfig(lags=4), full_training_time_steps=10, threshold_multiplier=10)
    model = PanelModel(spark, cfg).fit(seen.where("time < 28"), SPEC).partial_fit(seen.where("time >= 28"))
    rows = model.summary().collect()
    assert len(rows) == 2 and rows[0]["end_t"] == rows[1]["start_t"] - 1 and 28 < rows[1]["start_t"] <= 34
    assert model.query(None, (25, 35), "metric", "a0").where("value is not null").count() == 220


def test_missing_values_and_checks(spark):
    rows = [(1, 1, "x", float("nan")), (1, 2, "x", 0.0), (2, 1, "y", None), (2, 2, "y", 4.0)]
    df = spark.createDataFrame(rows, "unit int, time int, action string, metric double")
    p = panel.canonical(df, SPEC)
    assert p.where("metric is null").count() == 2
    encoded = panel.encode(p, panel.large_dimension(p, "unit"), panel.small_dimension(p, "time"), panel.small_dimension(p, "action"))
    assert panel.observed(encoded).count() == 2 and panel.assignment(encoded).count() == 4
    with pytest.raises(ValueError, match="several rows"):
        panel.check_panel(p.union(p))
    with pytest.raises(ValueError, match="missing"):
        panel.check_panel(p.withColumn("metric", F.lit(None).cast("double")))
    two = panel.canonical(df.withColumn("b", F.lit("z")), PanelSpec("unit", "time", ("action", "b"), "metric"))
    assert {r["action"] for r in two.collect()} == {"x-z", "y-z"}
    with pytest.raises(ValueError, match="fitted"):
        PanelModel(spark).summary()
    with pytest.raises(ValueError, match="unknown imputer"):
        PanelModel(spark, ModelConfig(imputer="nothing")).fit(df.where("metric is not null"), SPEC)


def test_large_dimension_is_dense_and_sorted(spark):
    d = spark.range(1000).select((F.col("id") * 7 % 1000).alias("unit")).repartition(9)
    got = sorted(map(tuple, panel.large_dimension(d, "unit").collect()))
    assert got == [(k, k) for k in range(1000)]


def test_snn_groups_share_anchors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, 30))
    seen = np.ones(x.shape, bool)
    seen[:10, 20:] = False
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(seen), strict=True)]
    cells = spark.createDataFrame(rows, "row_id int, col_id int, value double")
    missing = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(~seen), strict=True)], "row_id int, col_id int")
    got = snn.snn_impute(cells, missing, SnnConfig(max_rank=2)).collect()
    assert len(got) == 100 and all(r["feasible"] and abs(r["value"] - x[r["row_id"], r["col_id"]]) < 1e-6 for r in got)


def test_generator_effects_policies_and_estimands(spark):
    g = synth.sales_scenario(n_units=40, n_times=12)
    truth = g.truth(spark).persist()
    cf = truth.select(F.col("unit_idx").alias("unit"), F.col("time_idx").alias("time"), F.col("action_idx").cast("string").alias("action"), "value")
    means = {r["action_idx"]: r["m"] for r in truth.groupBy("action_idx").agg(F.avg("value").alias("m")).collect()}
    effect = {r["action"]: r["effect"] for r in estimands.ate(cf, "0").collect()}
    assert abs(means[1] / means[0] - 1.1) < 1e-6 and abs(effect["2"] - 0.25 * means[0]) < 1e-6
    tail = synth.auto_subsample(truth, [synth.Period(12, "random_unit", missing="tail", observed_share=0.0)], 12, 3)
    assert 0 < tail.count() < 480
    assert g.stamped(tail).schema["time"].dataType.typeName() == "timestamp"
    with pytest.raises(ValueError):
        synth.auto_subsample(truth, [synth.Period(5)], 12, 3)
    with pytest.raises(ValueError):
        synth.Period(3, "unknown")
    cov = synth.IntCov("discount", (0, 1, 1), low=0, high=10)
    d = truth.withColumn("discount", cov.column("action_idx", ["unit_idx", "time_idx"]))
    assert d.where("action_idx = 0 and discount >= 5 or action_idx > 0 and discount < 5").count() == 0
    assert sum(len(x) for x in synth.IntCov("c", (0, 1), tuple("abcd")).category_groups()) == 4


def test_ipw_learners_agree_with_saturated(spark):
    d = spark.range(4000).select(F.col("id").alias("unit"), F.lit(0).alias("time"), (F.col("id") % 3).cast("string").alias("x"))
    u = F.pmod(F.xxhash64("unit"), F.lit(1000)) / 1000
    d = d.withColumn("action", F.when(u < 0.2 + 0.2 * F.col("x").cast("int"), "t").otherwise("c")).withColumn("metric", F.col("x").cast("double") * 3 + F.when(F.col("action") == "t", 2.0).otherwise(0.0)).persist()
    naive = estimands.naive_ate(d, "c").first()["effect"]
    exact = estimands.ipw_saturated(d, ["x"], "c").first()["effect"]
    assert abs(exact - 2) < 1e-9 < abs(naive - 2)
    for learner in ("logistic", "forest"):
        assert abs(estimands.ipw(d, ["x"], "c", learner).first()["effect"] - 2) < 0.3
    assert all(abs(r["effect"] - 2) < 0.5 for r in estimands.doubly_robust(d, ["x"], "c", "linear").collect())


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime.date(2020, 1, 1), "a", 1.23456789012), (1, datetime.date(2020, 1, 2), "b", 2.0)], "unit int, time date, action string, metric double")
    io.write_csv(df, f"file://{tmp_path}/c", 3)
    back = io.read_csv(spark, f"file://{tmp_path}/c", df.schema)
    assert sorted(r["metric"] for r in back.collect()) == [1.235, 2.0]
    io.write_table(df, f"file://{tmp_path}/p", partition_by=["action"])
    assert io.read_table(spark, f"file://{tmp_path}/p").count() == 2
    pre, post = io.intervention_layout(df, datetime.date(2020, 1, 2))
    assert pre.columns == ["unit", "2020-01-01"] and post.columns == ["unit", "action", "2020-01-02"]
    assert io.from_pandas(spark, df.toPandas(), 2).count() == 2


def test_snn_does_not_copy_anchor_rows_to_missing_rows(spark, monkeypatch):
    """What a missing row meets is as small for many anchor rows as for few."""
    sizes, made = [], snn.Anchors.to_bytes
    rng = np.random.default_rng(5)
    for n in (60, 600):
        x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 30))
        a = snn.Anchors.of(x[:, :20], x[:, 20:], SnnConfig(max_rank=2, n_neighbors=2))
        sizes.append(len(made(a)))
        again = snn.Anchors.from_bytes(made(a), 20, 10, a.cfg)
        y = x[0]
        for one in (a, again):
            value, ok = one.fill(y[:20])
            assert ok.all() and np.allclose(value, y[20:])
    assert sizes[0] == sizes[1]


def test_pairs_that_lack_a_value_are_not_broadcast(spark):
    """The lists they are unfolded from are small, so that all pairs went to the driver."""
    cells = spark.createDataFrame([(i, j, float((i + 1) * (j + 1))) for i in range(400) for j in range(60) if (i + j) % 5 == 0], "row_id int, col_id int, value double").persist()
    d = bicluster.als_impute(cells, panel.missing_of_rows(cells, 400, 60), AlsConfig(ranks=(1,), sweeps=2))
    found = d.collect()
    assert len(found) == 400 * 48
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(plan):
        if "BroadcastExchange" in line:
            below = [x for n, x in enumerate(plan[k + 1 :], k + 1) if all(depth(y) > depth(line) for y in plan[k + 1 : n + 1])]
            assert not any("Generate explode" in x for x in below)
    assert any("Generate explode" in x for x in plan)
