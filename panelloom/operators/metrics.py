"""Accuracy of estimates as aggregations."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mape(d: DataFrame, truth: str, estimate: str) -> DataFrame:
    """Ratio of means: 100 * mean |truth - estimate| / mean truth."""
    return d.where(F.col(truth).isNotNull() & F.col(estimate).isNotNull()).agg((100 * F.avg(F.abs(F.col(truth) - F.col(estimate))) / F.avg(truth)).alias("mape"))


def accuracy(d: DataFrame, truth: str, estimate: str, feasible: str | None = None) -> DataFrame:
    """One row: mse, rmse, r2, estimated and feasible counts over rows that have both values."""
    both = F.col(truth).isNotNull() & F.col(estimate).isNotNull()
    t, e = F.when(both, F.col(truth)), F.when(both, F.col(estimate))
    sse = F.sum(F.pow(t - e, 2))
    extra = [F.sum(F.col(feasible).cast("long")).alias("n_feasible")] if feasible else []
    return d.agg(F.avg(F.pow(t - e, 2)).alias("mse"), F.sqrt(F.avg(F.pow(t - e, 2))).alias("rmse"), (1 - sse / (F.count(t) * F.var_pop(t))).alias("r2"), F.count(t).alias("n_estimated"), *extra)


def timed(run: Callable[[], object]) -> tuple[object, float]:
    """(result, seconds)."""
    began = time.perf_counter()
    return run(), time.perf_counter() - began
