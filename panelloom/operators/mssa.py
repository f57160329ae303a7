"""Singular-spectrum forecasting of factor series: one small kernel for each factor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.functions.forecasters import FACTORIES
from panelloom.functions.kernels import ar_fit, mssa_fit, mssa_predict
from panelloom.spec import MssaConfig

FORECASTERS = "factor int, coefs array<double>, ar_coefs array<double>, rank int, n_steps int"


def factor_series(factors: DataFrame) -> DataFrame:
    """(factor, t, value) of a model's time factors."""
    return factors.where("mode = 'time'").select(F.col("idx").alias("t"), F.posexplode("vec").alias("factor", "value"))


def masked_series(series: DataFrame, known_share: DataFrame, certainty: float = 0.5) -> DataFrame:
    """Values at steps whose share of known cells is below ``certainty`` become NULL."""
    share = known_share.select(F.col("time_idx").alias("t"), "known_share")
    return series.join(share, "t", "left").select("factor", "t", F.when(F.coalesce("known_share", F.lit(1.0)) >= certainty, F.col("value")).alias("value"))


def _ordered(f: pd.DataFrame) -> np.ndarray:
    return f.sort_values("t")["value"].to_numpy(float)


def fit_forecasters(series: DataFrame, cfg: MssaConfig) -> DataFrame:
    """FORECASTERS of each factor's (factor, t, value) series; a series of one step has none."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        ts = _ordered(f)
        if len(ts) < 2:
            return pd.DataFrame({"factor": [], "coefs": [], "ar_coefs": [], "rank": [], "n_steps": []})
        coefs, ar, rank, _ = mssa_fit(ts, cfg.lags, cfg.rank, cfg.rank_rule, cfg.energy, cfg.page, cfg.column_nan_share, cfg.ar_order)
        return pd.DataFrame({"factor": [f["factor"].iloc[0]], "coefs": [coefs.tolist()], "ar_coefs": [ar.tolist()], "rank": [rank], "n_steps": [len(ts)]})

    return series.groupBy("factor").applyInPandas(fit, FORECASTERS)


def updated(forecasters: DataFrame, regime: int, n_new: int) -> DataFrame:
    """Forecasters of a model after ``n_new`` steps came to the series of a regime: fitted as they were, with a longer history."""
    return forecasters.withColumn("n_steps", F.when(F.col("regime") == regime, F.col("n_steps") + n_new).otherwise(F.col("n_steps")).cast("int"))


def fit_autoregression(series: DataFrame, order: int) -> DataFrame:
    """(factor, phi): autoregressions without intercept of each factor's (factor, t, value) series, latest lag first."""

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"factor": [f["factor"].iloc[0]], "phi": [ar_fit(_ordered(f), order).tolist()]})

    return series.groupBy("factor").applyInPandas(fit, "factor int, phi array<double>")


def forecast_autoregression(series: DataFrame, order: int, horizon: int) -> DataFrame:
    """(factor, step, value) of steps 1 to ``horizon`` after each series by its own autoregression."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        past = _ordered(f)
        phi = ar_fit(past, order)
        out = mssa_predict(past, phi[::-1], horizon)
        return pd.DataFrame({"factor": f["factor"].iloc[0], "step": np.arange(1, horizon + 1), "value": out})

    return series.groupBy("factor").applyInPandas(run, "factor int, step int, value double")


def forecast_series(series: DataFrame, forecasters: DataFrame, horizon: int, cfg: MssaConfig) -> DataFrame:
    """(factor, step, value) for ``horizon`` steps after each series; NULL where its history has gaps.

    A forecaster registered under another name than ``mssa`` is fitted to the history where it forecasts.
    """
    if cfg.model != "mssa" and cfg.model not in FACTORIES:
        raise ValueError(f"unknown forecaster {cfg.model!r}; known: {', '.join(sorted(FACTORIES))}")
    factory = None if cfg.model == "mssa" else FACTORIES[cfg.model]

    def run(key: tuple, history: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if not len(history) or not len(model):
            return pd.DataFrame({"factor": [], "step": [], "value": []})
        ts = _ordered(history)
        if factory is not None:
            out = factory(cfg).fit(ts).predict(horizon)
            return pd.DataFrame({"factor": key[0], "step": np.arange(horizon), "value": [None if np.isnan(v) else v for v in out]})
        coefs, ar = np.asarray(model["coefs"].iloc[0], float), np.asarray(model["ar_coefs"].iloc[0], float)
        noise = None
        if len(ar):
            noise = np.nan_to_num(ts - mssa_fit(ts, cfg.lags, cfg.rank, cfg.rank_rule, cfg.energy, cfg.page, cfg.column_nan_share, 0)[3][: len(ts)])
        out = mssa_predict(ts, coefs, horizon, ar, noise)
        return pd.DataFrame({"factor": key[0], "step": np.arange(horizon), "value": [None if np.isnan(v) else v for v in out]})

    return series.groupBy("factor").cogroup(forecasters.groupBy("factor")).applyInPandas(run, "factor int, step int, value double")


def forecast_factors(forecast: DataFrame, start: int) -> DataFrame:
    """Forecasts as time factors: (mode, idx, vec) with idx from ``start``."""
    vec = F.transform(F.array_sort(F.collect_list(F.struct("factor", "value"))), lambda x: x["value"])
    return forecast.groupBy("step").agg(vec.alias("vec")).select(F.lit("time").alias("mode"), (F.col("step") + start).cast("int").alias("idx"), "vec")
