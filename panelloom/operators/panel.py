"""From a long panel to a sparse tensor: dictionaries, encoding, checks, masks, display.

Missing is an absent row or NULL, never NaN. A tensor is a table (unit_idx, time_idx, action_idx, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.sources.scratch import stored
from panelloom.spec import PanelSpec

SEPARATOR = "-"


def action_label(actions: tuple[str, ...] | list[str]) -> Column:
    """Action columns joined with a dash; NULL if one of them is."""
    parts = [F.col(a).cast("string") for a in actions]
    return parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.lit(SEPARATOR), p)][1:])


def canonical(df: DataFrame, spec: PanelSpec, time_type: str | None = None) -> DataFrame:
    """(unit, time, action, metric, covariates...): NaN metrics become NULL, time is cast if asked."""
    metric = F.col(spec.metric).cast("double")
    time = F.col(spec.time).cast(time_type) if time_type else F.col(spec.time)
    return df.select(F.col(spec.unit).alias("unit"), time.alias("time"), action_label(spec.actions).alias("action"), F.when(~F.isnan(metric), metric).alias("metric"), *[F.col(c) for c in spec.covariates])


def duplicate_keys(panel: DataFrame) -> DataFrame:
    """Cells that more than one row claims: (unit, time, n)."""
    return panel.groupBy("unit", "time").agg(F.count("*").alias("n")).where("n > 1")


def check_panel(panel: DataFrame) -> None:
    """Raise on duplicate cells or when no metric is known at all."""
    twice = duplicate_keys(panel).limit(1).collect()
    if twice:
        raise ValueError(f"several rows for unit {twice[0]['unit']!r} at {twice[0]['time']!r}")
    if panel.where("metric is not null and action is not null").isEmpty():
        raise ValueError("all values are missing")


def small_dimension(values: DataFrame, name: str, offset: int = 0) -> DataFrame:
    """Dense index by value of a dictionary that is small by nature (actions, time steps)."""
    return values.select(name).where(F.col(name).isNotNull()).distinct().select(name, (F.row_number().over(Window.orderBy(name)) - 1 + offset).cast("int").alias(f"{name}_idx"))


def large_dimension(values: DataFrame, name: str) -> DataFrame:
    """Dense index by value of a dictionary of any size: a distributed sort, then offsets of its partitions.

    The sorted rows are written before their partitions are counted, so that a lost executor can't deal
    them out anew between the two.
    """
    rank = values.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
    rank = stored(rank, "ranked")
    ends = rank.groupBy("part").agg(F.count("*").alias("n"))
    base = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # one row for each partition of the sort
    return rank.join(F.broadcast(base), "part").select(name, (F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1)).cast("int").alias(f"{name}_idx"))


def sample_rows(panel: DataFrame, share: float, keys: list[str], seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, chosen by a hash of ``keys``: the same ones in every run and however rows are dealt."""
    return panel.where(F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def in_both(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Distinct values that both panels hold."""
    return a.select(*columns).intersect(b.select(*columns))


def in_first_only(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of the first panel that the second doesn't hold."""
    return a.select(*columns).subtract(b.select(*columns))


def encode(panel: DataFrame, units: DataFrame, times: DataFrame, actions: DataFrame) -> DataFrame:
    """(unit_idx, time_idx, action_idx, value) of every panel row; unknown actions have NULL."""
    return panel.join(units, "unit").join(times, "time").join(actions, "action", "left").select("unit_idx", "time_idx", "action_idx", F.col("metric").alias("value"))


def observed(encoded: DataFrame) -> DataFrame:
    """The tensor's known cells."""
    return encoded.where("value is not null and action_idx is not null")


def assignment(encoded: DataFrame) -> DataFrame:
    """(unit_idx, time_idx, action_idx): the action taken, also where the metric is missing."""
    return encoded.where("action_idx is not null").select("unit_idx", "time_idx", "action_idx")


def grid(*dims: DataFrame) -> DataFrame:
    """All combinations of small dictionaries with one of any size, the first: the tensor's coordinates."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(F.broadcast(d))  # time steps or actions
    return out


def missing_cells(cells: DataFrame, obs: DataFrame) -> DataFrame:
    """Coordinates of ``cells`` that ``obs`` doesn't hold."""
    keys = [c for c in cells.columns if c in obs.columns]
    return cells.join(obs.select(keys), keys, "left_anti")


def missing_of_rows(obs: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """(row_id, col_id) of a whole matrix that ``obs`` doesn't hold: rows meet their known columns as lists, no cell meets another.

    The optimizer takes pairs for as large as the lists they are unfolded from, and would send them to the driver to be
    broadcast; so they are merged with what they meet.
    """
    known = obs.groupBy("row_id").agg(F.collect_set("col_id").alias("known"))
    rows = obs.sparkSession.range(n_rows).select(F.col("id").cast("int").alias("row_id"))
    cols = F.sequence(F.lit(0), F.lit(n_cols - 1)).cast("array<int>")
    gone = F.when(F.col("known").isNull(), cols).otherwise(F.array_except(cols, F.col("known")))
    return rows.join(known.hint("merge"), "row_id", "left").select("row_id", F.explode(gone).alias("col_id")).hint("merge")


def density(panel: DataFrame) -> DataFrame:
    """One row: units, times, actions, known cells and their share of the tensor."""
    n = panel.where("metric is not null").agg(F.countDistinct("unit").alias("n_units"), F.countDistinct("time").alias("n_times"), F.countDistinct("action").alias("n_actions"), F.count("*").alias("n_cells"))
    return n.withColumn("density", F.round(F.col("n_cells") / (F.col("n_units") * F.col("n_times") * F.col("n_actions")), 6))


def new_batch_mask(obs: DataFrame, columns: DataFrame, least: int = 3) -> DataFrame:
    """(time_idx, action_idx) of ``columns`` that at most ``least`` units observe: masked for all units."""
    seen = obs.groupBy("time_idx", "action_idx").agg(F.count("*").alias("n"))
    return columns.select("time_idx", "action_idx").join(seen, ["time_idx", "action_idx"], "left").where(F.coalesce("n", F.lit(0)) <= least).select("time_idx", "action_idx")


def to_wide(long: DataFrame, value: str = "value", times: list | None = None) -> DataFrame:
    """Units by times, for display; give the times to spare the pass that finds them."""
    return long.groupBy("unit").pivot("time", times).agg(F.first(value))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """0/1 columns ``column_value`` for the given categories."""
    return df.select("*", *[F.coalesce(F.col(column) == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values])


def last_window(panel: DataFrame, interval: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): test is the last ``interval`` (such as ``16 weeks``) of the time axis."""
    end = panel.agg(F.max("time").alias("end"))
    marked = panel.crossJoin(F.broadcast(end)).withColumn("cut", F.expr(f"`end` - interval {interval}"))  # one row
    return marked.where("time <= cut").drop("end", "cut"), marked.where("time > cut").drop("end", "cut")
