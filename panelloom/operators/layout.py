"""Matrix layouts of tensors and series as computed columns and joins."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _page_length(n_times: int, L: int | None) -> int:
    L = L or 1
    if n_times % L:
        raise ValueError(f"{n_times} time steps can't be cut into pages of {L}")
    return L


def to_page(cells: DataFrame, n_times: int, L: int | None = None, start: int = 0) -> DataFrame:
    """Tensor cells with row_id = unit*L + t mod L and col_id = action*(T/L) + t div L."""
    L = _page_length(n_times, L)
    t = F.col("time_idx") - start
    return cells.withColumn("row_id", (F.col("unit_idx") * L + F.pmod(t, F.lit(L))).cast("int")).withColumn("col_id", (F.col("action_idx") * (n_times // L) + F.floor(t / L)).cast("int"))


def from_page(cells: DataFrame, n_times: int, L: int | None = None, start: int = 0) -> DataFrame:
    """Inverse of to_page: adds unit_idx, time_idx and action_idx."""
    L = _page_length(n_times, L)
    m = n_times // L
    return cells.withColumn("unit_idx", F.floor(F.col("row_id") / L).cast("int")).withColumn("action_idx", F.floor(F.col("col_id") / m).cast("int")).withColumn("time_idx", (F.pmod("col_id", F.lit(m)) * L + F.pmod("row_id", F.lit(L)) + start).cast("int"))


def to_horizontal_page(cells: DataFrame, n_times: int, n_actions: int, L: int) -> DataFrame:
    """Rows are t mod L; each (unit, action) has a block of T/L columns."""
    L = _page_length(n_times, L)
    m = n_times // L
    block = F.col("unit_idx") * n_actions + F.col("action_idx")
    return cells.withColumn("row_id", F.pmod("time_idx", F.lit(L)).cast("int")).withColumn("col_id", (block * m + F.floor(F.col("time_idx") / L)).cast("int"))


def from_horizontal_page(cells: DataFrame, n_times: int, n_actions: int, L: int) -> DataFrame:
    m = n_times // _page_length(n_times, L)
    block = F.floor(F.col("col_id") / m)
    return cells.withColumn("unit_idx", F.floor(block / n_actions).cast("int")).withColumn("action_idx", F.pmod(block, F.lit(n_actions)).cast("int")).withColumn("time_idx", (F.pmod("col_id", F.lit(m)) * L + F.col("row_id")).cast("int"))


def series_to_page(series: DataFrame, n: int, L: int) -> DataFrame:
    """(i, j, value) with i = t mod L, j = t div L; steps beyond the last whole page go."""
    return series.where(F.col("t") < n - n % L).select(F.pmod("t", F.lit(L)).cast("int").alias("i"), F.floor(F.col("t") / L).cast("int").alias("j"), "value")


def page_to_series(page: DataFrame, L: int) -> DataFrame:
    return page.select((F.col("j") * L + F.col("i")).cast("int").alias("t"), "value")


def series_to_hankel(series: DataFrame, n: int, L: int, keys: list[str] | None = None) -> DataFrame:
    """(keys..., i, j, value) with H[i, j] = series[i + j]: each step is copied to its rows, without a join."""
    low, high = F.greatest(F.lit(0), F.col("t") - (n - L)), F.least(F.lit(L - 1), F.col("t"))
    copies = series.select(*(keys or []), "t", "value", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("i"))
    return copies.select(*(keys or []), "i", (F.col("t") - F.col("i")).cast("int").alias("j"), "value")


def hankel_to_series(hankel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of the anti-diagonals."""
    return hankel.groupBy(*(keys or []), (F.col("i") + F.col("j")).cast("int").alias("t")).agg(F.avg("value").alias("value"))


def column_sparsity(cells: DataFrame, column: str, n_rows: int, most: float = 0.3) -> DataFrame:
    """(column, missing_share) of columns with less than ``most`` of ``n_rows`` values missing."""
    share = 1 - F.count("value") / n_rows
    return cells.groupBy(column).agg(share.alias("missing_share")).where(F.col("missing_share") < most)


def vector_product(*vectors: Column) -> Column:
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda a, b: a * b)
    return out


def vector_sum(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x)


def merge_factors(units: DataFrame, actions: DataFrame, n_units: int) -> DataFrame:
    """Rows of the Khatri-Rao product: (row_id = action*N + unit, vec); actions are few."""
    a = actions.select("action_idx", F.col("vec").alias("w"))
    return units.select("unit_idx", F.col("vec").alias("u")).crossJoin(F.broadcast(a)).select((F.col("action_idx") * n_units + F.col("unit_idx")).cast("int").alias("row_id"), vector_product(F.col("w"), F.col("u")).alias("vec"))


def parameter_grid(options: dict[str, list]) -> list[dict]:
    """All combinations of named lists of values."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]
