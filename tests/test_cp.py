import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions.kernels import masked_cp
from panelloom.operators import cp, panel
from panelloom.spec import CpConfig


def test_distributed_fit_reaches_the_driver_kernels_error(spark):
    rng = np.random.default_rng(2)
    f = [rng.uniform(0.5, 2, (n, 2)) for n in (12, 10, 3)]
    full = np.einsum("nk,tk,ik->nti", *f)
    seen = rng.random(full.shape) < 0.6
    rows = [(int(n), int(t) + 5, int(i), float(full[n, t, i])) for n, t, i in zip(*np.nonzero(seen), strict=True)]
    cells = spark.createDataFrame(rows, "unit_idx int, time_idx int, action_idx int, value double").persist()
    for limit in (10, 10_000):
        factors = cp.fit_cp(spark, cells, CpConfig(rank=2, sweeps=6 if limit == 10 else 200, driver_cells=limit), full.shape, 5)
        assert {(r["mode"], r["n"]) for r in factors.groupBy("mode").agg(F.count("*").alias("n")).collect()} == {("unit", 12), ("time", 10), ("action", 3)}
        error = cp.mean_drift(cells, factors).first()["mean_drift"]
        assert error < (0.02 if limit == 10 else 1e-4)
    arrays = cp.factor_arrays(factors)
    assert arrays["unit"].shape == (12, 2)


def test_distributed_fit_equals_the_driver_kernel(spark):
    rng = np.random.default_rng(4)
    full = rng.normal(3, 2, (8, 6, 3))
    seen = rng.random(full.shape) < 0.7
    seen[5] = False
    rows = [(int(n), int(t) + 5, int(i), float(full[n, t, i])) for n, t, i in zip(*np.nonzero(seen), strict=True)]
    cells = spark.createDataFrame(rows, "unit_idx int, time_idx int, action_idx int, value double").persist()
    # by the number of sweeps, then by the tolerance
    for sweeps, tolerance in ((3, 1e-9), (30, 0.2)):
        here, there = (cp.factor_arrays(cp.fit_cp(spark, cells, CpConfig(rank=2, sweeps=sweeps, tolerance=tolerance, driver_cells=limit), full.shape, 5)) for limit in (10, 10_000))
        assert all(np.allclose(here[m], there[m], rtol=1e-6, atol=1e-9) for m in cp.MODES)


def test_time_factors_of_new_steps(spark):
    rng = np.random.default_rng(3)
    f = [rng.uniform(0.5, 2, (n, 2)) for n in (9, 4, 3)]
    full = np.einsum("nk,tk,ik->nti", *f)
    cells = spark.createDataFrame([(n, t, (n + t) % 3, float(full[n, t, (n + t) % 3])) for n in range(9) for t in range(4)], "unit_idx int, time_idx int, action_idx int, value double")
    factors = cp.factor_rows(spark, f)
    new = {r["idx"]: r["vec"] for r in cp.new_time_factors(cells, factors, 2).collect()}
    assert np.allclose([new[t] for t in range(4)], f[1], atol=1e-6)
    fitted = cp.evaluate(cells, factors, "fitted")
    assert fitted.where(F.abs(F.col("fitted") - F.col("value")) > 1e-9).count() == 0


def test_fits_by_blocks_equal_the_dense_kernel(spark, monkeypatch):
    """Passes on the driver, passes in the cluster and aggregations begin, sweep and end as masked_cp does."""
    rng = np.random.default_rng(7)
    full = rng.normal(3, 2, (40, 6, 3))
    seen = rng.random(full.shape) < 0.5
    seen[[5, 39]] = False
    index = np.nonzero(seen)
    rows = [(int(n), int(t), int(i), float(full[n, t, i])) for n, t, i in zip(*index, strict=True)]
    cells = spark.createDataFrame(rows, "unit_idx int, time_idx int, action_idx int, value double").persist()
    monkeypatch.setattr(cp, "BLOCK_CELLS", 50)
    for sweeps, tolerance in ((4, 1e-9), (40, 0.2)):
        want = masked_cp(list(index), full[index], full.shape, 2, sweeps, 1e-8, tolerance, 0)
        for limit, others in ((10, 18), (10_000, 18), (10, 17)):
            monkeypatch.setattr(cp, "OTHER_CELLS", others)
            got = cp.factor_arrays(cp.fit_cp(spark, cells, CpConfig(rank=2, sweeps=sweeps, tolerance=tolerance, driver_cells=limit), full.shape))
            assert all(np.allclose(got[m], f, rtol=1e-6, atol=1e-9) for m, f in zip(cp.MODES, want, strict=True))


def test_a_sweep_is_one_job_that_brings_back_sums_alone(spark, monkeypatch):
    """The distributed fit took four jobs a sweep, and the driver's fit held all cells several times over."""
    cells = spark.range(3000).select((F.col("id") / 10).cast("int").alias("unit_idx"), (F.col("id") % 10).cast("int").alias("time_idx"), (F.col("id") % 3).cast("int").alias("action_idx"), F.rand(1).alias("value")).persist()
    cells.count()
    spark.sparkContext.setJobGroup("fit", "fit")
    cp.fit_cp(spark, cells, CpConfig(rank=2, sweeps=12, tolerance=0.0, driver_cells=10), (300, 10, 3))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 24
    frames = [cp.column_sums(*(np.zeros(5, int), np.arange(5), np.ones(5)), np.ones((2, 5)), 1e-8)]
    assert [x.shape for x in frames[0]] == [(5, 5), (2,)]


def test_grids_and_evaluations_move_no_cells_to_meet_small_dictionaries(spark):
    """Unhinted, a grid was a product of partitions and an evaluation shuffled all cells once a mode."""
    big, small = spark.range(50).select(F.col("id").cast("int").alias("unit_idx")).repartition(3), spark.range(9).select(F.col("id").cast("int").alias("time_idx")).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = panel.grid(big, small, spark.range(2).select(F.col("id").cast("int").alias("action_idx")))
        assert "CartesianProduct" not in cells._jdf.queryExecution().toString() and cells.count() == 900
        factors = cp.factor_rows(spark, [np.ones((50, 2)), np.ones((9, 2)), np.ones((2, 2))])
        plan = cp.evaluate(cells, factors)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_complete_rows_are_swept_by_their_triangle():
    """A sweep over complete rows took as long as there were rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (200, 12))
    seen = np.ones(x.shape, bool)
    seen[::9, 4] = False
    first, other = (i.astype(np.int32) for i in np.nonzero(seen))
    block = (first, other, x[seen])
    small = cp.reduced([tuple(c[first < 90] for c in block), tuple(c[first >= 90] for c in block)], 12)
    assert sum(len(b[0]) for b in small) == 23 * 11 + 12 * 12
    z, now = rng.uniform(0.5, 1.5, (2, 3, 12))
    total = lambda of, blocks: [sum(p) for p in zip(*(of(*b) for b in blocks), strict=True)]
    for want, got in zip(total(lambda *b: cp.column_sums(*b, z, 1e-6), [block]), total(lambda *b: cp.column_sums(*b, z, 1e-6), small), strict=True):
        assert np.allclose(got, want, rtol=1e-9)
    assert np.isclose(sum(cp.factor_error(*b, z, now, 1e-6) for b in small), cp.factor_error(*block, z, now, 1e-6), rtol=1e-9)
    # as many cells as a complete row, with one of them twice, are no complete row
    twice = (np.zeros(3, np.int32), np.array([0, 0, 2], np.int32), np.ones(3))
    assert len(cp.reduced([twice], 3)[0][0]) == 3 and cp.reduced([twice], 3)[0][1].tolist() == [0, 0, 2]


def test_all_sweeps_are_one_job(spark, monkeypatch):
    """Each sweep was a job; where the blocks don't fit the tasks it still is."""
    cells = spark.range(3000).select((F.col("id") / 10).cast("int").alias("unit_idx"), (F.col("id") % 10).cast("int").alias("time_idx"), (F.col("id") % 3).cast("int").alias("action_idx"), F.rand(1).alias("value")).persist()
    cells.count()
    monkeypatch.setattr(cp, "BLOCK_CELLS", 500)

    def run(kept: int, sweeps: int) -> tuple[int, dict]:
        monkeypatch.setattr(cp, "KEPT_MB", kept)
        group = f"fit {kept} {sweeps}"
        spark.sparkContext.setJobGroup(group, group)
        factors = cp.factor_arrays(cp.fit_cp(spark, cells, CpConfig(rank=2, sweeps=sweeps, tolerance=-1.0, driver_cells=10), (300, 10, 3)))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return jobs, factors

    few, _ = run(128, 2)
    many, shared = run(128, 12)
    single, apart = run(0, 12)
    assert few == many < single
    assert all(np.allclose(shared[m], apart[m], rtol=1e-6, atol=1e-9) for m in cp.MODES)


def test_split_judges_held_cells_like_a_fit_of_the_others(spark):
    """Cells packed once with their mark give the factors and errors of tables that are parted first; an index whose cells are all held has zeros."""
    rng = np.random.default_rng(4)
    cells = [(i, j, float((1 + i % 5) * (2 + j % 3) + rng.normal() / 4), bool(i == 7 or j == 3 or rng.random() < 0.2)) for i in range(40) for j in range(9) if rng.random() < 0.8 or i == 7]
    known = spark.createDataFrame(cells, "row_idx int, col_idx int, value double, held boolean")
    settings = (2, 30, 1e-8, 1e-9, 3)
    for driver_cells in (10_000, 0):
        split = cp.Split(spark, known, ("row", "col"), (40, 9), driver_cells, len(cells))
        train = cp.Packed(spark, known.where("not held").drop("held"), ("row", "col"), (40, 9), driver_cells)
        fitted = cp.evaluate(known.where("held"), cp.factors_table(train.fit(*settings)), "fitted", ("row", "col"), 2)
        want = fitted.selectExpr("avg(pow(fitted - value, 2))").first()[0]
        assert split.error(split.train(), *settings) == pytest.approx(want, rel=1e-9)
        assert (split.n, split.learnt, split.held) == (len(cells), sum(not c[3] for c in cells), sum(c[3] for c in cells))
        whole, alone = split.whole().fit(*settings), cp.Packed(spark, known.drop("held"), ("row", "col"), (40, 9), driver_cells).fit(*settings)
        for m in ("row", "col"):
            a, b = (np.array([r["vec"] for r in d[m].orderBy("idx").collect()]) for d in (whole, alone))
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def test_triangles_become_one_before_they_come_to_the_driver(spark, monkeypatch):
    """Each partition sent its triangle, as rows: up to ``driver_cells`` cells, pickled in the JVM."""
    frame, brought = type(spark.range(0)), []
    for name, rows in (("collect", len), ("toArrow", lambda t: t.num_rows)):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name), n=rows: (out := f(self), brought.append(n(out)))[0])
    monkeypatch.setattr(cp, "BLOCK_CELLS", 40)
    x = np.random.default_rng(5).uniform(0.5, 2, (400, 4))
    cells = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(400) for j in range(4)], "row_idx int, col_idx int, value double").persist()
    packed = cp.Packed(spark, cells, ("row", "col"), (400, 4), 1000)
    assert packed.here and brought and max(brought) == 1
    (_, other, value), = packed.kept
    r = value.reshape(4, 4)
    assert other.tolist() == list(range(4)) * 4 and np.allclose(r.T @ r, x.T @ x)
    packed.unpersist()
