"""The panel model: fit, query, forecast and incremental updates over tables.

A model is a set of tables: dictionaries (unit, time, action), ``assignment``, ``obs`` (known cells),
``nan_mask`` (cells the imputer could not fill), ``factors`` keyed by regime, ``regimes``, ``drift`` and
``forecasters``. Queries are joins over them; nothing of the size of the tensor is ever collected.
"""

from __future__ import annotations

import io
import json
import zipfile
from abc import ABC, abstractmethod
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import panelloom.operators.bicluster  # noqa: F401  registers its imputers
from panelloom.operators import cp, drift, layout, mssa, panel
from panelloom.operators.snn import IMPUTERS
from panelloom.sources.scratch import at_once, new_path, read_files, remove, stored, write_bytes
from panelloom.spec import AlsConfig, BiclusterConfig, CpConfig, ModelConfig, MssaConfig, PanelSpec, SnnConfig

TABLES = ("units", "times", "actions", "assignment", "obs", "nan_mask", "factors", "regimes", "drift", "forecasters", "unit_covariates")


class WhatIfModel(ABC):
    """What every counterfactual algorithm offers."""

    @abstractmethod
    def query(self, units, time, metric, action, action_time_range=None) -> DataFrame: ...

    @abstractmethod
    def diagnostics(self) -> DataFrame: ...

    @abstractmethod
    def summary(self) -> DataFrame: ...

    @abstractmethod
    def save(self, path: str) -> None: ...


class PanelModel(WhatIfModel):
    """Counterfactuals and forecasts of one metric of a panel."""

    def __init__(self, spark: SparkSession, config: ModelConfig | None = None) -> None:
        self.spark, self.config, self.spec = spark, config or ModelConfig(), None
        self.tables: dict[str, DataFrame] = {}
        self.counts: dict[str, int] = {}
        self.late: DataFrame | None = None

    def __repr__(self) -> str:
        known = {**self.counts, "imputer": self.config.imputer, "L": self.config.L, "rank": self.config.cp.rank, "metric": self.spec.metric if self.spec else None}
        return f"PanelModel({', '.join(f'{k}={known[k]!r}' for k in sorted(known))})"

    # ------------------------------------------------------------------ fitting

    def _keep(self, df: DataFrame) -> DataFrame:
        """Cut lineage: a table in the shared folder, whose size the optimizer knows."""
        return stored(df, "model")

    def _require(self) -> None:
        gone = [t for t in TABLES if t not in self.tables and t not in ("forecasters", "unit_covariates")]
        if self.spec is None or gone:
            raise ValueError(f"the model isn't fitted: {', '.join(gone) or 'spec'} missing")

    @property
    def N(self) -> int | None:
        return self.counts.get("N")

    @property
    def T(self) -> int | None:
        return self.counts.get("T")

    @property
    def I(self) -> int | None:  # noqa: E743
        return self.counts.get("I")

    def fit(self, df: DataFrame, spec: PanelSpec) -> PanelModel:
        """Fit a long panel; the caller's DataFrame isn't changed."""
        self.spec = spec
        rows = self._keep(panel.canonical(df, spec))
        t = self.tables

        def counted(d: DataFrame) -> tuple[DataFrame, int]:
            kept = self._keep(d)
            return kept, kept.count()

        _, (t["units"], n), (t["times"], steps), (t["actions"], n_actions) = at_once(
            lambda: panel.check_panel(rows), lambda: counted(panel.large_dimension(rows, "unit")), lambda: counted(panel.small_dimension(rows, "time")), lambda: counted(panel.small_dimension(rows, "action"))
        )
        self.counts = {"N": n, "T": steps, "I": n_actions}
        encoded = self._keep(panel.encode(rows, t["units"], t["times"], t["actions"]))
        t["assignment"], t["obs"] = panel.assignment(encoded), panel.observed(encoded)
        if spec.covariates:
            t["unit_covariates"] = rows.groupBy("unit").agg(*[F.min(c).alias(c) for c in spec.covariates])
        t["regimes"] = self.spark.createDataFrame([(0, 0, None, None, self.T)], drift.REGIMES)
        t["drift"] = self.spark.createDataFrame([], "time_idx int, distance_error double, cusum double")
        t["nan_mask"] = self.spark.createDataFrame([], "unit_idx int, time_idx int, action_idx int")
        t["factors"] = self.spark.createDataFrame([], "regime int, mode string, idx int, vec array<double>")
        t["forecasters"] = self.spark.createDataFrame([], "regime int, " + mssa.FORECASTERS)
        self._fit_regime(0, 0)
        return self

    def _grid(self, start: int, end: int, units: DataFrame) -> DataFrame:
        """Coordinates of ``units`` from step ``start`` to before ``end``: units by two small dictionaries."""
        t = self.tables
        small = t["times"].where(F.col("time_idx").between(start, end - 1)).select("time_idx").crossJoin(F.broadcast(t["actions"].select("action_idx")))
        return units.select("unit_idx").crossJoin(small)

    def _fit_regime(self, regime: int, start: int) -> None:
        """Impute, mask, compress and measure the open regime, and fit its forecasters."""
        t, cfg, steps = self.tables, self.config, self.T - start
        obs = t["obs"].where(F.col("time_idx") >= start).select("unit_idx", "time_idx", "action_idx", "value")
        cells = layout.to_page(obs, steps, cfg.L, start).select("row_id", "col_id", "value")
        L = cfg.L or 1
        missing = panel.missing_of_rows(cells, self.N * L, self.I * steps // L)
        if cfg.imputer not in IMPUTERS:
            raise ValueError(f"unknown imputer {cfg.imputer!r}; known: {', '.join(sorted(IMPUTERS))}")
        filled = self._keep(IMPUTERS[cfg.imputer](cells, missing, cfg))
        self.tables["filled"] = layout.from_page(filled, steps, cfg.L, start).select("unit_idx", "time_idx", "action_idx", "value", "feasible")
        # both are scans of stored tables
        tensor = obs.unionByName(self.tables["filled"].where("value is not null").select("unit_idx", "time_idx", "action_idx", "value"))
        mask = t["nan_mask"].where("false") if cfg.imputer == "none" else self._unfilled(tensor, start, steps)
        t["nan_mask"] = self._keep(drift.append_mask(t["nan_mask"], mask, start))
        factors = cp.fit_cp(self.spark, tensor, cfg.cp, (self.N, steps, self.I), start)
        self._set_factors(regime, factors)
        spread = cp.mean_drift(obs, self.tables["factors"].where(F.col("regime") == regime).drop("regime"), cfg.cp.rank).first()["mean_drift"]
        t["regimes"] = self._keep(t["regimes"].where(F.col("regime") != regime).unionByName(self.spark.createDataFrame([(regime, start, None, spread, steps)], drift.REGIMES)))
        zeros = t["times"].where(F.col("time_idx") >= start).select("time_idx", F.lit(0.0).alias("distance_error"), F.lit(0.0).alias("cusum"))
        t["drift"] = self._keep(t["drift"].where(F.col("time_idx") < start).unionByName(zeros))
        self._fit_forecasters(regime, start)

    def _unfilled(self, tensor: DataFrame, start: int, steps: int) -> DataFrame:
        """Coordinates that the tensor lacks; only units that lack some are looked at."""
        full = tensor.groupBy("unit_idx").agg(F.count("*").alias("n")).where(F.col("n") == steps * self.I)
        short = self._keep(self.tables["units"].select("unit_idx").join(full, "unit_idx", "left_anti"))
        keys = ["unit_idx", "time_idx", "action_idx"]
        if short.isEmpty():
            return tensor.where("false").select(*keys)
        return panel.missing_cells(self._grid(start, self.T, short), tensor.select(*keys).join(short, "unit_idx", "left_semi"))

    def _set_factors(self, regime: int, factors: DataFrame) -> None:
        rest = self.tables["factors"].where(F.col("regime") != regime)
        self.tables["factors"] = self._keep(rest.unionByName(factors.select(F.lit(regime).alias("regime"), "mode", "idx", "vec")))

    def _known_share(self, start: int) -> DataFrame:
        gone = self.tables["nan_mask"].where(F.col("time_idx") >= start).groupBy("time_idx").agg(F.count("*").alias("n"))
        steps = self.tables["times"].where(F.col("time_idx") >= start).select("time_idx")
        return steps.join(gone, "time_idx", "left").select("time_idx", (1 - F.coalesce("n", F.lit(0)) / (self.N * self.I)).alias("known_share"))

    def _fit_forecasters(self, regime: int, start: int) -> None:
        factors = self.tables["factors"].where(F.col("regime") == regime)
        series = mssa.masked_series(mssa.factor_series(factors), self._known_share(start), self.config.certainty)
        models = mssa.fit_forecasters(series, self.config.mssa).select(F.lit(regime).alias("regime"), "*")
        rest = self.tables["forecasters"].where(F.col("regime") != regime)
        self.tables["forecasters"] = self._keep(rest.unionByName(models))

    # ------------------------------------------------------------------ reading

    def _check_metric(self, metric: str | None) -> None:
        self._require()
        if metric is not None and metric != self.spec.metric:
            raise ValueError(f"the model knows {self.spec.metric!r}, not {metric!r}")

    def _units(self, units: list | None) -> DataFrame:
        """(pos, unit, unit_idx) of the wanted units in their order, repeats included."""
        known = self.tables["units"]
        if units is None:
            return known.select(F.col("unit_idx").cast("long").alias("pos"), "unit", "unit_idx")
        rows = self.spark.createDataFrame([(k, u) for k, u in enumerate(units)], f"pos long, unit {known.schema['unit'].dataType.simpleString()}")
        found = rows.join(known, "unit", "left")
        unknown = [r["unit"] for r in found.where("unit_idx is null").limit(5).collect()]
        if unknown:
            raise KeyError(f"unknown units {unknown}")
        return found

    def _action_index(self, action: str) -> int:
        row = self.tables["actions"].where(F.col("action") == action).first()
        if row is None:
            raise KeyError(f"unknown action {action!r}")
        return row["action_idx"]

    def _times(self, span: tuple | list | None) -> DataFrame:
        times = self.tables["times"]
        if span is None:
            return times
        kind = times.schema["time"].dataType
        return times.where(F.col("time").between(F.lit(span[0]).cast(kind), F.lit(span[1]).cast(kind)))

    def _valued(self, coordinates: DataFrame) -> DataFrame:
        """Coordinates (unit_idx, time_idx, action_idx, ...) with value, NULL where masked, and observed."""
        d = drift.regime_of(coordinates, self.tables["regimes"]).drop("start_t", "end_t")
        for mode in cp.MODES:
            f = self.tables["factors"].where(F.col("mode") == mode).select("regime", F.col("idx").alias(f"{mode}_idx"), F.col("vec").alias(f"f_{mode}"))
            d = d.join(F.broadcast(f) if mode in cp.SMALL_MODES else f, ["regime", f"{mode}_idx"], "left")
        value = layout.vector_sum(layout.vector_product(*[F.col(f"f_{m}") for m in cp.MODES]))
        keys = ["unit_idx", "time_idx", "action_idx"]
        masked = self.tables["nan_mask"].select(*keys, F.lit(True).alias("masked"))
        seen = self.tables["obs"].select(*keys, F.lit(True).alias("seen"))
        d = d.join(masked, keys, "left").join(seen, keys, "left")
        return d.withColumn("value", F.when(F.col("masked").isNull(), value)).withColumn("observed", F.coalesce("seen", F.lit(False))).drop("masked", "seen", *[f"f_{m}" for m in cp.MODES])

    def query(self, units, time, metric, action, action_time_range=None) -> DataFrame:
        """(pos, unit, time, action, value, observed): the metric had ``action`` been taken in a range.

        Both ranges include their ends; outside ``action_time_range`` (all of ``time`` by default) the
        action that was taken counts. Values are the low-rank reconstruction, NULL where the imputer had
        no anchors or no action is known. An empty window gives no rows.
        """
        self._check_metric(metric)
        wanted = self._units(units).crossJoin(F.broadcast(self._times(time)))
        number = self._action_index(action)
        taken = self.tables["assignment"].select("unit_idx", "time_idx", F.col("action_idx").alias("taken"))
        d = wanted.join(taken, ["unit_idx", "time_idx"], "left")
        if action_time_range is None:
            d = d.withColumn("action_idx", F.lit(number))
        else:
            kind = self.tables["times"].schema["time"].dataType
            a, b = (F.lit(x).cast(kind) for x in action_time_range)
            d = d.withColumn("action_idx", F.when(F.col("time").between(a, b), F.lit(number)).otherwise(F.col("taken")))
        known = self._valued(d.where("action_idx is not null").drop("taken"))
        d = d.drop("taken").where("action_idx is null").select("pos", "unit", "time", "action_idx", F.lit(None).cast("double").alias("value"), F.lit(False).alias("observed"))
        out = known.select("pos", "unit", "time", "action_idx", "value", "observed").unionByName(d)
        return out.join(F.broadcast(self.tables["actions"]), "action_idx", "left").select("pos", "unit", "time", "action", "value", "observed")

    def counterfactuals(self, units: list | None = None, time=None) -> DataFrame:
        """(unit, time, action, value, observed) of every action: the input of the effect estimands."""
        self._require()
        cells = self._units(units).crossJoin(F.broadcast(self._times(time))).crossJoin(F.broadcast(self.tables["actions"]))
        return self._valued(cells).select("unit", "time", "action", "value", "observed")

    def forecast(self, units, horizon: int, metric, action) -> DataFrame:
        """(pos, unit, step, action, value): steps T to T+horizon-1 under ``action``, from the latest regime."""
        self._check_metric(metric)
        regime = self.tables["regimes"].where("end_t is null").first()
        factors = self.tables["factors"].where(F.col("regime") == regime["regime"]).drop("regime")
        models = self.tables["forecasters"].where(F.col("regime") == regime["regime"]).drop("regime")
        series = mssa.masked_series(mssa.factor_series(factors), self._known_share(regime["start_t"]), self.config.certainty)
        ahead = mssa.forecast_factors(mssa.forecast_series(series, models, horizon, self.config.mssa), self.T)
        steps = self.spark.range(self.T, self.T + horizon).select(F.col("id").cast("int").alias("time_idx"))
        number = self._action_index(action)
        cells = self._units(units).crossJoin(F.broadcast(steps)).withColumn("action_idx", F.lit(number))
        d = cp.evaluate(cells, factors.where("mode <> 'time'").unionByName(ahead), rank=self.config.cp.rank)
        return d.select("pos", "unit", F.col("time_idx").alias("step"), F.lit(action).alias("action"), F.when(~F.isnan("value"), F.col("value")).alias("value"))

    @staticmethod
    def to_wide(result: DataFrame, times: list | None = None) -> DataFrame:
        """Units by times (or steps) for display."""
        column = "time" if "time" in result.columns else "step"
        return result.groupBy("unit").pivot(column, times).agg(F.first("value"))

    # ------------------------------------------------------------------ appending

    def partial_fit(self, df: DataFrame) -> PanelModel:
        """Append later time steps: refit a young regime, else update time factors and test for drift.

        Rows at or before the last known step are late: they are set aside in ``late``. New units raise;
        unknown actions are kept out of the tensor.
        """
        self._require()
        t, old = self.tables, self.T
        rows = self._keep(panel.canonical(df, self.spec))
        panel.check_panel(rows)
        last = t["times"].agg(F.max("time").alias("last"))
        rows = rows.crossJoin(F.broadcast(last))  # one row
        self.late = rows.where("time <= last").drop("last")
        rows = rows.where("time > last").drop("last")
        strangers = rows.join(t["units"], "unit", "left_anti").select("unit").limit(5).collect()
        if strangers:
            raise ValueError(f"units the model doesn't know: {[r[0] for r in strangers]}")
        new_times = self._keep(panel.small_dimension(rows, "time", old))
        n_new = new_times.count()
        if not n_new:
            return self
        t["times"] = self._keep(t["times"].unionByName(new_times))
        self.counts["T"] = old + n_new
        encoded = self._keep(panel.encode(rows, t["units"], new_times, t["actions"]))
        fresh = panel.observed(encoded)
        t["assignment"] = self._keep(t["assignment"].unionByName(panel.assignment(encoded)))
        t["obs"] = self._keep(t["obs"].unionByName(fresh))
        regime = t["regimes"].where("end_t is null").first()
        number, start = regime["regime"], regime["start_t"]
        if regime["n_full_steps"] < self.config.full_training_time_steps:
            self._fit_regime(number, start)
            return self
        factors = t["factors"].where(F.col("regime") == number).drop("regime")
        new = self._keep(cp.new_time_factors(fresh, factors, self.config.cp.rank, self.config.min_singular_value))
        steps = cp.evaluate(fresh, factors.where("mode <> 'time'").unionByName(new), "fitted")
        distances = new_times.select("time_idx").join(drift.distance(steps), "time_idx", "left")
        before = t["drift"].where(F.col("time_idx") < old).orderBy(F.desc("time_idx")).first()
        spread = regime["mean_drift"] or 0.0
        series = self._keep(drift.cusum(distances, spread, before["cusum"] if before else 0.0))
        t["drift"] = self._keep(t["drift"].unionByName(series.select("time_idx", "distance_error", "cusum")))
        shift = drift.shift_time(t["drift"], self.config.threshold_multiplier * spread, start).first()["shift_time"]
        if shift is not None and shift > start:
            self._append_time_factors(number, new.where(F.col("idx") < shift))
            self._append_mask(fresh.where(F.col("time_idx") < shift), old, shift)
            t["regimes"] = self._keep(drift.split_regime(t["regimes"], shift))
            self._fit_regime(number + 1, shift)
        else:
            self._append_time_factors(number, new)
            self._append_mask(fresh, old, self.T)
            # forecasters keep their coefficients; their history is the table of time factors
            t["forecasters"] = self._keep(mssa.updated(t["forecasters"], number, n_new))
        return self

    def _append_time_factors(self, regime: int, new: DataFrame) -> None:
        self.tables["factors"] = self._keep(self.tables["factors"].unionByName(new.select(F.lit(regime).alias("regime"), "mode", "idx", "vec")))

    def _append_mask(self, fresh: DataFrame, start: int, end: int) -> None:
        """New (time, action) columns that three units or fewer observe are masked for all units."""
        if self.config.imputer == "none" or start >= end:
            return
        columns = self.tables["times"].where(F.col("time_idx").between(start, end - 1)).crossJoin(F.broadcast(self.tables["actions"]))
        gone = panel.new_batch_mask(fresh, columns).crossJoin(self.tables["units"].select("unit_idx")).select("unit_idx", "time_idx", "action_idx")
        self.tables["nan_mask"] = self._keep(drift.append_mask(self.tables["nan_mask"], gone, start))

    # ------------------------------------------------------------------ about the model

    def summary(self) -> DataFrame:
        """One row a regime: span, drift and size."""
        self._require()
        return self.tables["regimes"].withColumn("n_units", F.lit(self.N)).withColumn("n_actions", F.lit(self.I)).orderBy("regime")

    def diagnostics(self) -> DataFrame:
        """(time_idx, time, observed, masked, feasible, distance_error, cusum) of every step."""
        self._require()
        t = self.tables
        count = lambda d, name: d.groupBy("time_idx").agg(F.count("*").alias(name))
        ok = t["filled"].where("feasible") if "filled" in t else t["obs"].where("false")
        d = t["times"].join(count(t["obs"], "observed"), "time_idx", "left").join(count(t["nan_mask"], "masked"), "time_idx", "left").join(count(ok, "feasible"), "time_idx", "left").join(t["drift"], "time_idx", "left")
        return d.na.fill(0, ["observed", "masked", "feasible"])

    # ------------------------------------------------------------------ saving

    def save(self, path: str) -> None:
        """One Parquet table each and ``model.json`` below ``path``, in any store Spark writes to."""
        self._require()
        present = [n for n in (*TABLES, "filled") if n in self.tables]
        for name in present:
            self.tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
        meta = json.dumps({"spec": asdict(self.spec), "config": asdict(self.config), "counts": self.counts, "tables": present})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PanelModel:
        meta = json.loads(spark.read.text(f"{path}/model.json", wholetext=True).first()[0])
        model = cls(spark, _config(meta["config"]))
        spec = meta["spec"]
        model.spec = PanelSpec(spec["unit"], spec["time"], tuple(spec["actions"]), spec["metric"], tuple(spec["covariates"]))
        model.counts = meta["counts"]
        model.tables = {n: spark.read.parquet(f"{path}/{n}") for n in meta["tables"]}
        model._require()
        return model

    def to_bytes(self) -> bytes:
        """The saved folder as a zip; for models that fit the driver."""
        path = new_path(self.spark, "model-bytes")
        self.save(path)
        try:
            files = read_files(self.spark, path)
        finally:
            remove(self.spark, path)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in sorted(files.items()):
                z.writestr(name, data)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes) -> PanelModel:
        """A model from ``to_bytes``, unpacked into the shared folder, where its tables stay."""
        path = new_path(spark, "model-bytes")
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for name in z.namelist():
                write_bytes(spark, f"{path}/{name}", z.read(name))
        return cls.load(spark, path)


def _config(d: dict[str, Any]) -> ModelConfig:
    parts = {"cp": CpConfig, "snn": SnnConfig, "bicluster": BiclusterConfig, "als": AlsConfig, "mssa": MssaConfig}
    fixed = {k: parts[k](**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()}) if k in parts else v for k, v in d.items()}
    return ModelConfig(**fixed)
