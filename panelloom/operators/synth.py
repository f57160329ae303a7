"""Synthetic panels of known truth: factors, effects, assignments and missingness.

Everything random is a hash of coordinates and a seed, so the same seed gives the same panel on any
number of partitions. Truth is (unit, time, action, value); panels are drawn from it by policies.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.operators.drift import regime_of
from panelloom.operators.layout import vector_product, vector_sum
from panelloom.sources.io import write_csv, write_table


@dataclass(frozen=True)
class UnitCov:
    """A unit covariate: its categories, or a range if it is continuous."""

    name: str
    categories: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1.0

    @property
    def discrete(self) -> bool:
        return bool(self.categories)


@dataclass(frozen=True)
class Metric:
    name: str
    low: float | None = None
    high: float | None = None
    difference: bool = False
    initial: float = 0.0

    def __post_init__(self) -> None:
        if self.low is not None and self.high is not None and self.low >= self.high:
            raise ValueError("a metric's range must not be empty")


@dataclass(frozen=True)
class IntCov:
    """An intervention covariate: each action draws from its division of a range or of categories."""

    name: str
    assignment: tuple[int, ...]
    categories: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1.0
    divisions: int | None = None

    def __post_init__(self) -> None:
        if not self.assignment:
            raise ValueError("assignment names a division for each action")
        if max(self.assignment) >= self.n_divisions or min(self.assignment) < 0:
            raise ValueError("assignment names a division that isn't there")

    @property
    def n_divisions(self) -> int:
        return self.divisions or max(self.assignment) + 1

    def thresholds(self) -> list[float]:
        return np.linspace(self.low, self.high, self.n_divisions + 1).tolist()

    def category_groups(self, seed: int = 0) -> list[list[str]]:
        """Categories split at random, non-empty parts, one for each division."""
        rng = np.random.default_rng(seed)
        names = list(rng.permutation(list(self.categories)))
        cuts = np.sort(rng.choice(np.arange(1, len(names)), self.n_divisions - 1, replace=False)) if self.n_divisions > 1 else []
        return [list(map(str, g)) for g in np.split(np.array(names), cuts)]

    def conditions(self, seed: int = 0) -> list[dict[str, Any]]:
        """What identifies each action: a range or a set of categories."""
        if self.categories:
            groups = self.category_groups(seed)
            return [{"column": self.name, "type": "categorical", "values": groups[d]} for d in self.assignment]
        t = self.thresholds()
        return [{"column": self.name, "type": "range", "lower": t[d], "upper": t[d + 1]} for d in self.assignment]

    def column(self, action: str, key: list[str], seed: int = 0) -> Column:
        """A value for each row, uniform in its action's division."""
        u = uniform(seed, self.name, *key)
        if self.categories:
            pick = lambda g: F.element_at(F.array(*map(F.lit, g)), (F.floor(u * len(g)) + 1).cast("int"))
            values = [pick(c["values"]) for c in self.conditions(seed)]
        else:
            values = [F.lit(c["lower"]) + u * (c["upper"] - c["lower"]) for c in self.conditions()]
        out = F.when(F.col(action) == 0, values[0])
        for k, v in enumerate(values[1:], 1):
            out = out.when(F.col(action) == k, v)
        return out


def uniform(seed: int, salt: str, *key: str) -> Column:
    """A number in [0, 1) from a hash of columns."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *key), F.lit(1 << 40)) / float(1 << 40)


def normal(seed: int, salt: str, *key: str) -> Column:
    """A standard normal number from hashes of columns (Box and Muller)."""
    u, v = uniform(seed, salt + "u", *key), uniform(seed, salt + "v", *key)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * np.pi * v)


@dataclass
class Generator:
    """Low-rank truth of N units, T steps and I actions in one or several regimes."""

    n_units: int
    n_times: int
    n_actions: int
    rank: int = 3
    regimes: tuple[int, ...] = ()
    trend: str = "linear"
    same_subspace: bool = False
    low: float = 0.0
    high: float = 100.0
    noise: float = 0.0
    seed: int = 0
    covariates: tuple[UnitCov, ...] = ()
    freq: str | None = "1 day"
    start: str = "2020-01-01"
    effects: list[dict[str, Any]] = field(default_factory=list)
    #: Regimes of even length, where ``regimes`` doesn't say when they begin.
    n_regimes: int = 1

    def starts(self) -> list[int]:
        if self.regimes:
            return [0, *self.regimes]
        return [self.n_times * k // self.n_regimes for k in range(self.n_regimes)]

    def generate(self, spark: SparkSession, time_range: tuple[int, int], noise: float | None = None) -> tuple[DataFrame, DataFrame]:
        """(truth, observed with noise) of the steps from the first to the last of ``time_range``, both included.

        Slices of one generator are parts of one panel: neither truth nor noise depends on how it is cut.
        """
        inside = F.col("time_idx").between(*time_range)
        clean, noisy = replace(self, noise=0.0), replace(self, noise=self.noise if noise is None else noise)
        return clean.truth(spark).where(inside), noisy.truth(spark).where(inside)

    def initial_factors(self) -> dict[str, np.ndarray]:
        """Factors by name: units and actions have an axis of regimes; all are small enough for a broadcast."""
        rng = np.random.default_rng(self.seed)
        units, actions, n = [], [], len(self.starts())
        for k in range(n):
            u = rng.uniform(-0.5, 0.5, (self.n_units, self.rank))
            if self.same_subspace and k:
                u = units[0][rng.permutation(self.n_units)]
            units.append(u)
            actions.append(2 * rng.uniform(0, 1, (self.n_actions, self.rank)))
        t = np.arange(self.n_times) / max(1, self.n_times)
        cycles, phase, slope = rng.uniform(1, 6, self.rank), rng.uniform(0, 2 * np.pi, self.rank), rng.uniform(-1, 1, self.rank)
        power = 1 if self.trend == "linear" else 2
        return {"unit": np.stack(units), "action": np.stack(actions), "time": np.sin(2 * np.pi * np.outer(t, cycles) + phase) + np.outer(t**power, slope)}

    def regime_table(self, spark: SparkSession) -> DataFrame:
        starts = self.starts()
        ends = [s - 1 for s in starts[1:]] + [None]
        return spark.createDataFrame(list(zip(range(len(starts)), starts, ends, strict=True)), "regime int, start_t int, end_t int")

    def add_effect(self, action: int, effect: float, condition: str = "true") -> Generator:
        """Set the mean of ``action`` in a subpopulation to (1 + effect) times the control's at each step."""
        self.effects.append({"action": action, "effect": effect, "condition": condition})
        return self

    def truth(self, spark: SparkSession) -> DataFrame:
        """(unit_idx, time_idx, action_idx, value, covariates...)."""
        f = self.initial_factors()
        vec = lambda a: [float(x) for x in a]
        u = spark.createDataFrame([(k, i, vec(r)) for k, rs in enumerate(f["unit"]) for i, r in enumerate(rs)], "regime int, unit_idx int, u array<double>")
        a = spark.createDataFrame([(k, i, vec(r)) for k, rs in enumerate(f["action"]) for i, r in enumerate(rs)], "regime int, action_idx int, a array<double>")
        t = spark.createDataFrame([(i, vec(r)) for i, r in enumerate(f["time"])], "time_idx int, t array<double>")
        steps = regime_of(t, self.regime_table(spark)).select("regime", "time_idx", "t")
        cells = u.join(F.broadcast(steps), "regime").join(F.broadcast(a), "regime")
        cells = cells.select("unit_idx", "time_idx", "action_idx", vector_sum(vector_product(F.col("u"), F.col("t"), F.col("a"))).alias("raw"))
        span = cells.agg(F.max(F.abs("raw")).alias("top"), F.stddev_pop("raw").alias("std")).first()
        top = span["top"] or 1.0
        scaled = F.lit(self.low) + (F.col("raw") + top) / (2 * top) * (self.high - self.low)
        d = cells.withColumn("value", scaled).drop("raw")
        for c in self.covariates:
            d = d.join(self.unit_covariate(spark, c), "unit_idx")
        for e in self.effects:
            d = shifted_effect(d, e["action"], e["effect"], e["condition"])
        if self.noise:
            std = float(span["std"] or 0) * (self.high - self.low) / (2 * top) * self.noise
            d = d.withColumn("value", F.col("value") + std * normal(self.seed, "noise", "unit_idx", "time_idx", "action_idx"))
        return d

    def unit_covariate(self, spark: SparkSession, cov: UnitCov) -> DataFrame:
        """(unit_idx, cov): clusters of unit factors for categories, a scaled linear score otherwise."""
        f = self.initial_factors()["unit"][0]
        rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(f)], "unit_idx int, u array<double>")
        if not cov.discrete:
            w = np.random.default_rng(self.seed + len(cov.name)).uniform(-1, 1, f.shape[1])
            score = f @ w
            lo, hi = float(score.min()), float(score.max())
            s = vector_sum(vector_product(F.col("u"), F.array(*[F.lit(float(x)) for x in w])))
            return rows.select("unit_idx", (F.lit(cov.low) + (s - lo) / ((hi - lo) or 1) * (cov.high - cov.low)).alias(cov.name))
        d = rows.select("unit_idx", *[F.col("u")[k].alias(f"u{k}") for k in range(min(2, f.shape[1]))])
        x = VectorAssembler(inputCols=[c for c in d.columns if c != "unit_idx"], outputCol="x").transform(d)
        model = KMeans(k=len(cov.categories), seed=self.seed + 1, featuresCol="x").fit(x)
        return model.transform(x).select("unit_idx", F.element_at(F.array(*map(F.lit, cov.categories)), F.col("prediction") + 1).alias(cov.name))

    def stamped(self, d: DataFrame) -> DataFrame:
        """``time`` as a timestamp of the generator's frequency, or the step itself without one."""
        if self.freq is None:
            return d.withColumn("time", F.col("time_idx"))
        n, unit = self.freq.split()
        return d.withColumn("time", F.expr(f"timestampadd({unit.rstrip('s')}, time_idx * {n}, timestamp'{self.start}')"))


def shifted_effect(d: DataFrame, action: int, effect: float, condition: str = "true") -> DataFrame:
    """value + effect * mean_control - (mean_action - mean_control), for an action in a subpopulation at each step.

    The means are aggregated first, one row for each step, and joined back.
    """
    inside = F.coalesce(F.expr(condition), F.lit(False)) & (F.col("action_idx").isin(0, action))
    mean = lambda a: F.avg(F.when(F.col("action_idx") == a, F.col("value")))
    means = d.where(inside).groupBy("time_idx").agg(mean(0).alias("__control"), mean(action).alias("__own"))
    # one row for each time step
    d = d.join(F.broadcast(means), "time_idx", "left")
    new = F.col("value") + effect * F.col("__control") - (F.col("__own") - F.col("__control"))
    return d.withColumn("value", F.when(inside & (F.col("action_idx") == action), new).otherwise(F.col("value"))).drop("__control", "__own")


def metric_columns(d: DataFrame, metric: Metric, n_actions: int) -> DataFrame:
    """(unit_idx, time_idx, <metric>_0, <metric>_1, ...): what each action would have given, a column for each.

    Columns of a difference metric are named <metric>_change_0 and so on.
    """
    change = "_change" if metric.difference else ""
    names = [F.max(F.when(F.col("action_idx") == i, F.col("value"))).alias(f"{metric.name}{change}_{i}") for i in range(n_actions)]
    return d.groupBy("unit_idx", "time_idx").agg(*names)


def export(truth: DataFrame, seen: DataFrame, path: str, digits: int = 7) -> None:
    """The seen panel as a headed CSV, the whole truth and its mask of seen cells as Parquet, all below ``path``."""
    write_csv(seen, f"{path}/panel", digits)
    keys = ["unit_idx", "time_idx", "action_idx"]
    mask = truth.select(*keys).join(seen.select(*keys).withColumn("seen", F.lit(1)), keys, "left").na.fill(0, ["seen"])
    write_table(truth.select(*keys, "value"), f"{path}/truth", digits)
    write_table(mask, f"{path}/mask")


@dataclass(frozen=True)
class Period:
    """Steps before ``until`` (and from the period before) share an assignment and a missingness policy."""

    until: int
    assignment: str = "random"  # random | control | random_unit | cov_unit
    subpopulations: tuple[tuple[str, tuple[float, ...]], ...] = ()  # (condition, probabilities of actions)
    missing: str = "none"  # none | random | tail
    observed_share: float = 1.0

    def __post_init__(self) -> None:
        if self.assignment not in ("random", "control", "random_unit", "cov_unit"):
            raise ValueError(f"unknown assignment {self.assignment!r}")
        if self.assignment == "cov_unit" and not self.subpopulations:
            raise ValueError("cov_unit needs subpopulations")
        if self.missing not in ("none", "random", "tail") or not 0 <= self.observed_share <= 1:
            raise ValueError("missingness is none, random or tail, with a share between 0 and 1")


def by_probability(u: Column, probabilities: tuple[float, ...]) -> Column:
    """The action whose part of [0, 1) holds u."""
    total, out = 0.0, None
    for k, p in enumerate(probabilities[:-1]):
        total += p
        out = F.when(u < total, k) if out is None else out.when(u < total, k)
    return out.otherwise(len(probabilities) - 1) if out is not None else F.lit(0)


def assigned_action(period: Period, n_actions: int, k: int, seed: int) -> Column:
    if period.assignment == "control":
        return F.lit(0)
    key = ["unit_idx", "time_idx"] if period.assignment == "random" else ["unit_idx"]
    u = uniform(seed + k, "action", *key)
    if period.assignment != "cov_unit":
        return F.floor(u * n_actions).cast("int")
    out = None
    for condition, p in period.subpopulations:
        if abs(sum(p) - 1) > 1e-9:
            raise ValueError("probabilities must sum to one")
        c = by_probability(u, p)
        out = F.when(F.expr(condition), c) if out is None else out.when(F.expr(condition), c)
    return out.otherwise(0)


def before_tail(cut: Column) -> Column:
    """Whether a step is seen of a unit whose steps from ``cut`` on are missing."""
    return F.col("time_idx") < cut


def auto_subsample(truth: DataFrame, periods: list[Period], n_times: int, n_actions: int, seed: int = 0) -> DataFrame:
    """The panel a sequence of periods would have seen: (unit_idx, time_idx, action_idx, value, covariates...).

    Unseen rows are left out. ``tail`` drops, for each unit, all steps from a random one on.
    """
    ends = [p.until for p in periods]
    if ends != sorted(set(ends)) or (ends and ends[-1] != n_times):
        raise ValueError("periods must end in rising order, the last at the end of the panel")
    action, seen = None, None
    for k, p in enumerate(periods):
        inside = F.col("time_idx") < p.until
        a = assigned_action(p, n_actions, k, seed)
        if p.missing == "random":
            s = uniform(seed + k, "seen", "unit_idx", "time_idx") < p.observed_share
        elif p.missing == "tail":
            cut = F.floor(n_times / 4 + uniform(seed, "tail", "unit_idx") * (n_times - n_times / 4))
            s = before_tail(cut) | (uniform(seed + k, "tail-unit", "unit_idx") < p.observed_share)
        else:
            s = F.lit(True)
        action = F.when(inside, a) if action is None else action.when(inside, a)
        seen = F.when(inside, s) if seen is None else seen.when(inside, s)
    return truth.where((F.col("action_idx") == action) & seen)


def sample_metric(panel: DataFrame, metric: Metric) -> DataFrame:
    """Metric as it is reported: accumulated from an initial value if it is a difference, then clipped."""
    v = F.col("value")
    if metric.difference:
        v = metric.initial + F.sum("value").over(Window.partitionBy("unit_idx").orderBy("time_idx").rowsBetween(Window.unboundedPreceding, 0))
    if metric.low is not None:
        v = F.greatest(v, F.lit(metric.low))
    if metric.high is not None:
        v = F.least(v, F.lit(metric.high))
    return panel.withColumn(metric.name, v)


def si_scenario(n_times: int, n_actions: int, conditions: list[str]) -> list[Period]:
    """Control until half time, then one action for each unit by subpopulation."""
    p = [tuple(1.0 if a == k % n_actions else 0.0 for a in range(n_actions)) for k in range(len(conditions))]
    return [Period(n_times // 2, "control"), Period(n_times, "cov_unit", tuple(zip(conditions, p, strict=True)))]


def staggered_scenario(n_times: int, n_actions: int, conditions: list[str]) -> list[Period]:
    """Control for a quarter; subpopulations move to treatment at a half and three quarters."""
    hot = lambda a: tuple(1.0 if i == a else 0.0 for i in range(n_actions))
    stages = []
    for q, until in enumerate((n_times // 2, 3 * n_times // 4, n_times)):
        stages.append(Period(until, "cov_unit", tuple((c, hot((k % (n_actions - 1)) + 1) if k <= q else hot(0)) for k, c in enumerate(conditions))))
    return [Period(n_times // 4, "control"), *stages]


def random_scenario(n_times: int) -> list[Period]:
    return [Period(n_times, "random")]


def sales_scenario(seed: int = 0, n_units: int = 100, n_times: int = 50, **options) -> Generator:
    """Store sales: location and size covariates, a control and two advertisements."""
    covs = (UnitCov("location", ("New York", "LA", "Boston")), UnitCov("size", ("small", "medium", "large")))
    return Generator(n_units, n_times, 3, seed=seed, covariates=covs, **options).add_effect(1, 0.1).add_effect(2, 0.25)
