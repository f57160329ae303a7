"""What can be plugged in, exported, replayed and measured."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import kernels as K
from panelloom.functions.forecasters import SeriesModel, SingularSpectrum, register_forecaster
from panelloom.operators import bicluster, cp, mssa, panel, snn, synth
from panelloom.plans.model import PanelModel
from panelloom.sources import io, scratch
from panelloom.spec import AlsConfig, BiclusterConfig, CpConfig, ModelConfig, MssaConfig, PanelSpec, SnnConfig
from panelloom.streaming.ingest import ModelSink, arriving, panel_cells, read_events, stream_into
from panelloom.streaming.queries import streaming_partial_fit


def test_biclique_says_whether_it_is_exact():
    mask = np.random.default_rng(3).random((30, 40)) < 0.5
    rows, cols, exact = K.search_biclique(mask)
    assert exact and mask[np.ix_(rows, cols)].all()
    few = K.search_biclique(mask, 3)
    assert not few[2] and min(len(few[0]), len(few[1])) <= min(len(rows), len(cols))


def test_imputed_cells_say_whether_their_anchors_are_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(24, 2)) @ rng.normal(size=(2, 30)) + 5
    seen = rng.random(x.shape) < 0.6
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(seen), strict=True)], "row_id int, col_id int, value double")
    missing = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(~seen), strict=True)], "row_id int, col_id int")
    assert snn.snn_impute(cells, missing, SnnConfig(max_rank=2)).where("not exact").count() == 0
    assert snn.snn_impute(cells, missing, SnnConfig(max_rank=2, node_budget=1)).where("not exact").count() > 0


def test_als_is_the_same_on_both_sides_of_the_drivers_limit(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0.5, 2, (15, 2)) @ rng.uniform(0.5, 2, (2, 12))
    seen = rng.random(x.shape) < 0.7
    cells = spark.createDataFrame([(7 * int(i), 3 * int(j), float(x[i, j])) for i, j in zip(*np.nonzero(seen), strict=True)], "row_id int, col_id int, value double").persist()
    missing = spark.createDataFrame([(7 * int(i), 3 * int(j)) for i, j in zip(*np.nonzero(~seen), strict=True)] + [(1, 1)], "row_id int, col_id int")
    got = [{(r["row_id"], r["col_id"]): r["value"] for r in bicluster.als_impute(cells, missing, AlsConfig(ranks=(2,), sweeps=6, driver_cells=limit)).collect()} for limit in (0, 10_000)]
    assert set(got[0]) == set(got[1]) and len(got[0]) == int((~seen).sum())
    assert all(abs(got[0][k] - got[1][k]) < 1e-6 for k in got[0])


class Last(SeriesModel):
    """Repeats the last value."""

    def __init__(self, cfg):
        self.last = np.nan

    def fit(self, series):
        self.last = series[-1]
        return self

    def predict(self, steps):
        return np.full(steps, self.last)


def test_forecasters_can_be_registered(spark):
    register_forecaster("last", Last)
    s = spark.createDataFrame([(f, t, float(f * 10 + t)) for f in (0, 1) for t in range(8)], "factor int, t int, value double")
    for name, want in (("last", {(0, 0): 7.0, (0, 1): 7.0, (1, 0): 17.0, (1, 1): 17.0}), ("singular_spectrum", None)):
        cfg = MssaConfig(model=name, lags=3, rank=2)
        got = {(r["factor"], r["step"]): r["value"] for r in mssa.forecast_series(s, mssa.fit_forecasters(s, cfg), 2, cfg).collect()}
        assert got == want if want else abs(got[1, 1] - 19) < 1e-6
    with pytest.raises(ValueError, match="unknown forecaster"):
        mssa.forecast_series(s, s, 2, MssaConfig(model="nothing"))
    m = SingularSpectrum(MssaConfig(lags=3, rank=2)).fit(np.arange(10.0)).update(np.array([10.0, 11.0]))
    assert np.allclose(m.predict(2), [12, 13])
    with pytest.raises(NotImplementedError):
        Last(None).update(np.ones(2))
    with pytest.raises(ValueError):
        SingularSpectrum(MssaConfig()).fit(np.ones((2, 2)))


def test_slices_columns_and_export_of_a_generator(spark, tmp_path):
    g = synth.Generator(6, 12, 3, rank=2, seed=3, n_regimes=3, noise=0.5)
    assert g.starts() == [0, 4, 8]
    keys = ["unit_idx", "time_idx", "action_idx"]
    parts = [g.generate(spark, (a, b)) for a, b in ((0, 4), (5, 11))]
    whole = g.generate(spark, (0, 11))
    for k in (0, 1):
        assert sorted(map(tuple, parts[0][k].unionByName(parts[1][k]).select(*keys, "value").collect())) == sorted(map(tuple, whole[k].select(*keys, "value").collect()))
    assert whole[0].join(whole[1].withColumnRenamed("value", "noisy"), keys).where("abs(value - noisy) > 1e-9").count() > 0
    wide = synth.metric_columns(whole[0], synth.Metric("sales"), 3)
    assert wide.columns == ["unit_idx", "time_idx", "sales_0", "sales_1", "sales_2"] and wide.count() == 72
    seen = synth.auto_subsample(whole[0], synth.random_scenario(12), 12, 3)
    synth.export(whole[0], seen, f"file://{tmp_path}/x")
    assert io.read_table(spark, f"file://{tmp_path}/x/mask").agg(F.sum("seen")).first()[0] == 72 == len(io.read_csv(spark, f"file://{tmp_path}/x/panel", seen.schema).collect())


def test_blocks_of_anchors_must_be_known():
    assert bicluster.sane(np.ones((3, 3), bool)) and not bicluster.sane(np.zeros((3, 3), bool))
    assert not bicluster.sane(np.eye(4, dtype=bool)) and not bicluster.sane(np.array([[1, 1], [1, 0]], bool))


def test_a_batch_that_is_replayed_counts_once(spark, tmp_path):
    spec = PanelSpec("unit", "time", ("action",), "metric")
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(d) for d in range(16)]
    rows = lambda a, b: spark.createDataFrame([(u, days[t], "xy"[(u + t) % 2], float((u + 1) * (1 + (u + t) % 2))) for t in range(a, b) for u in range(6)], "unit int, time date, action string, metric double")
    cfg = ModelConfig(imputer="none", cp=CpConfig(rank=1, sweeps=50), mssa=MssaConfig(lags=3), full_training_time_steps=5)
    path = f"file://{tmp_path}/m"
    sink = ModelSink(PanelModel(spark, cfg), spec, path)
    sink(rows(0, 8), 0)
    sink(rows(6, 12), 1)
    sink(rows(6, 12), 1)
    assert sink.model.T == 12 and spark.read.parquet(f"{path}/late").count() == 12
    # a process that died after it had saved the model but before it wrote the state tries again
    again = ModelSink(PanelModel(spark, cfg), spec, path)
    scratch.remove(spark, f"{path}/state/batch=1")
    again(rows(6, 12), 1)
    assert again.model.T == 12 and spark.read.parquet(f"{path}/late").count() == 12
    again(rows(12, 16), 2)
    assert again.model.T == 16 and PanelModel.load(spark, f"{path}/model-2").T == 16


def test_samples_do_not_depend_on_partitions(spark):
    d = spark.range(5000).select(F.col("id").alias("unit"))
    a, b = ({r[0] for r in panel.sample_rows(d.repartition(n), 0.2, ["unit"]).collect()} for n in (1, 7))
    assert a == b and 800 < len(a) < 1200


def test_factors_of_matrices_and_tensors_share_one_loop(spark):
    cells = spark.createDataFrame([(i, j, float((i + 1) * (j + 1))) for i in range(5) for j in range(4) if (i + j) % 3], "row_idx int, col_idx int, value double").persist()
    for limit in (0, 1000):
        f = cp.fit_matrix(spark, cells, (5, 4), 1, 60, 1e-12, 1e-12, 0, limit)
        assert cp.evaluate(cells, f, "fitted", ("row", "col")).where("abs(fitted - value) > 1e-3").count() == 0


def test_pairs_with_the_same_anchors_are_estimated_at_once(monkeypatch):
    """Each pair built its anchors from dictionaries of all rows of its cluster."""
    rng = np.random.default_rng(3)
    x = rng.uniform(0.5, 2, (30, 2)) @ rng.uniform(0.5, 2, (2, 9)) + rng.normal(0, 0.01, (30, 9))
    seen = np.ones(x.shape, bool)
    seen[::3, 6:] = False
    seen[1, 2] = False
    i, j = np.nonzero(seen)
    member = np.where(i % 3 > 0, 1, 0) + np.where(j < 6, 2, 0)
    cells = pd.DataFrame({"kind": 0, "row_id": i, "col_id": j, "value": x[seen], "member": member})[member > 0]
    a, b = np.nonzero(~seen)
    pairs = pd.DataFrame({"kind": 1, "row_id": a, "col_id": b, "value": np.nan, "member": 0})
    calls = []
    monkeypatch.setattr(bicluster, "sane", lambda known: calls.append(1) or known.mean() >= 0.3)
    cfg = BiclusterConfig(rank=2)
    got = bicluster._block_estimator(cfg)((0,), pd.concat([cells, pairs]))
    assert len(calls) == 2 and len(got) == len(a) == 31 and got["feasible"].all()
    rows = np.flatnonzero(np.arange(30) % 3 > 0)
    r, c = K.masked_cp([np.searchsorted(rows, i[member == 3]), j[member == 3]], x[seen][member == 3], (20, 6), 2, 100, 1e-10, 1e-12, 0)
    low = r @ c.T
    for p, q, v in zip(got["row_id"], got["col_id"], got["value"], strict=True):
        ac, ar = np.flatnonzero(seen[p, :6]), np.flatnonzero(seen[rows, q])
        assert np.isclose(v, x[rows[ar], q] @ np.linalg.lstsq(low[np.ix_(ar, ac)].T, x[p, ac], rcond=1e-7)[0], rtol=1e-6)


def test_blocks_are_filtered_where_they_are_found_as_in_tables(spark):
    rng = np.random.default_rng(8)
    for share in (0.25, 0.4, 0.6):
        mask = (rng.random((12, 9)) < share).astype(int)
        rows, cols = np.arange(1, 11), np.array([0, 2, 3, 5, 8])
        d = spark.createDataFrame([(1, int(r), int(c), int(mask[r, c])) for r in rows for c in cols], "cluster int, row_id int, col_id int, seen int")
        want = bicluster.block_filter(d, 0.3, 0.35, 0.45).collect()
        got = bicluster.filtered(mask, rows, cols, 0.3, 0.35, 0.45)
        assert [sorted({w[k] for w in want}) for k in ("row_id", "col_id")] == [x.tolist() for x in got]


def test_a_batch_is_computed_once(spark, tmp_path):
    """Every use of a batch ran the stream's aggregation again."""
    runs = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            runs.add(len(f))
            yield f

    rows = [(u, t, "ab"[(u + t) % 2], float(1 + u + t)) for u in range(6) for t in range(8)]
    batch = spark.createDataFrame(rows, "unit int, time int, action string, metric double").mapInPandas(seen, "unit int, time int, action string, metric double")
    ModelSink(PanelModel(spark, ModelConfig(imputer="none", cp=CpConfig(rank=1, sweeps=5), mssa=MssaConfig(lags=2))), PanelSpec("unit", "time", ("action",), "metric"), f"file://{tmp_path}/model")(batch, 0)
    assert runs.value == len(rows)


def _events(spark, path, late_user=False):
    """Thirty days of events in an order that isn't time's, one without a time."""
    rng = np.random.default_rng(7)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=73 * i), i % 6, "abc"[i % 3], float(rng.uniform(1, 9))) for i in range(590)]
    rows += [(1000 + i, start + datetime.timedelta(days=25 + i), 99, "a", 2.0) for i in range(5)] if late_user else []
    rows = [rows[i] for i in rng.permutation(len(rows))] + [(9999, None, 1, "a", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(3).write.parquet(path)


def test_events_arrive_whole_and_in_order_of_time(spark, tmp_path):
    _events(spark, f"file://{tmp_path}/events.parquet")
    at = []
    for there in arriving(spark, f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/in", 24, 3):
        d = spark.read.parquet(there)
        at.append((d.count(), d.agg(F.max(F.to_date("ts"))).first()[0].day))
    assert d.columns == ["event_id", "ts", "user_id", "event_type", "value"]
    assert at == [(475, 24), (534, 27), (591, 30)]


def test_a_stream_fits_its_first_days_and_appends_the_others(spark, tmp_path, monkeypatch):
    """All events came in one batch, so that nothing was appended."""
    _events(spark, f"file://{tmp_path}/events.parquet")
    steps = []
    for name in ("fit", "partial_fit"):
        monkeypatch.setattr(PanelModel, name, lambda self, df, *a, f=getattr(PanelModel, name), n=name: (f(self, df, *a), steps.append((n, self.T)))[0])
    streaming_partial_fit(spark, f"file://{tmp_path}")
    # a day is final when an event of a day after its end was seen
    assert steps == [("fit", 22), ("partial_fit", 25), ("partial_fit", 28)]


def test_a_batch_with_new_units_is_fitted_with_all_cells(spark, tmp_path):
    """Its append raised, which ended the stream."""
    _events(spark, f"file://{tmp_path}/events.parquet", late_user=True)
    cfg = ModelConfig(imputer="none", cp=CpConfig(rank=1, sweeps=5), mssa=MssaConfig(lags=3))
    sink = ModelSink(PanelModel(spark, cfg), PanelSpec("unit", "time", ("action",), "metric"), f"file://{tmp_path}/m")
    for there in arriving(spark, f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/in", 24, 3):
        stream_into(panel_cells(read_events(spark, there)), sink, f"file://{tmp_path}/c").awaitTermination()
    d = spark.read.parquet(f"file://{tmp_path}/events.parquet").where("ts < timestamp_ntz'2024-01-29'")
    cells = d.select("user_id", F.to_date("ts")).distinct().count()
    assert (sink.model.N, sink.model.T, sink.model.tables["obs"].count()) == (7, 28, cells)
