"""Drift of a fitted regime: distances, cumulative sums, shifts and regime tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.cp import evaluate

REGIMES = "regime int, start_t int, end_t int, mean_drift double, n_full_steps int"


def distance(fitted: DataFrame, value: str = "value", fit: str = "fitted") -> DataFrame:
    """(time_idx, distance_error): mean squared error over mean square of each step; NULL without known cells."""
    return fitted.groupBy("time_idx").agg((F.avg(F.pow(F.col(fit) - F.col(value), 2)) / F.avg(F.pow(F.col(value), 2))).alias("distance_error"))


def drift_distance(obs: DataFrame, factors: DataFrame) -> DataFrame:
    return distance(evaluate(obs, factors, "fitted"))


def cusum(distances: DataFrame, mean_drift: Column | float, start: Column | float = 0.0, order: str = "time_idx") -> DataFrame:
    """``distances`` with c_t = max(c_{t-1} + d_t - mean_drift, 0), c before the first step being ``start``.

    Closed form: with S the running sum (of start and increments), c = S - min(0, least S so far). The
    series is one row for each time step of the panel. Steps without a distance add nothing.
    """
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mean = F.lit(mean_drift) if isinstance(mean_drift, (int, float)) else mean_drift
    first = F.lit(float(start)) if isinstance(start, (int, float)) else start
    d = distances.withColumn("_s", first + F.sum(F.coalesce(F.col("distance_error") - mean, F.lit(0.0))).over(w))
    return d.withColumn("cusum", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w))).drop("_s")


def shift_time(series: DataFrame, threshold: Column | float, start: int = 0) -> DataFrame:
    """One row: the first step from ``start`` whose cusum exceeds the threshold, or NULL."""
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return series.where(F.col("time_idx") >= start).agg(F.min(F.when(F.col("cusum") > limit, F.col("time_idx"))).alias("shift_time"))


def regime_of(steps: DataFrame, regimes: DataFrame) -> DataFrame:
    """``steps`` (time_idx, ...) with the regime that holds each: regimes are a handful of rows."""
    r = regimes.select("regime", "start_t", "end_t")
    inside = (F.col("time_idx") >= F.col("start_t")) & (F.col("time_idx") <= F.coalesce("end_t", F.lit(2**31 - 1)))
    return steps.join(F.broadcast(r), inside)


def split_regime(regimes: DataFrame, shift: int) -> DataFrame:
    """Close the open regime one step before ``shift`` and open the next there."""
    closed = regimes.withColumn("end_t", F.when(F.col("end_t").isNull(), F.lit(shift - 1)).otherwise(F.col("end_t")).cast("int"))
    new = regimes.agg((F.max("regime") + 1).cast("int").alias("regime")).select("regime", F.lit(shift).cast("int").alias("start_t"), F.lit(None).cast("int").alias("end_t"))
    return closed.unionByName(new, allowMissingColumns=True)


def append_mask(old: DataFrame, new: DataFrame, start: int) -> DataFrame:
    """The mask before ``start`` and the new one from there."""
    return old.where(F.col("time_idx") < start).unionByName(new)
