"""Average effects from counterfactuals, and naive, inverse-propensity and doubly robust baselines."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def effects(counterfactuals: DataFrame, control: str, by: list[str] | None = None) -> DataFrame:
    """(by..., action, effect): mean over (unit, time) of the action's value less the control's.

    ``counterfactuals`` has (unit, time, action, value, by...). Each (unit, time) is grouped once and
    holds all its actions, so no self-join is needed; pairs where either value is NULL are skipped.
    """
    by = by or []
    w = Window.partitionBy("unit", "time")
    base = F.max(F.when(F.col("action") == control, F.col("value"))).over(w)
    d = counterfactuals.withColumn("diff", F.col("value") - base).where(F.col("action") != control)
    return d.groupBy(*by, "action").agg(F.avg("diff").alias("effect"))


def ate(counterfactuals: DataFrame, control: str) -> DataFrame:
    return effects(counterfactuals, control)


def ate_by_time(counterfactuals: DataFrame, control: str) -> DataFrame:
    return effects(counterfactuals, control, ["time"])


def cate(counterfactuals: DataFrame, units: DataFrame, covariates: list[str], control: str) -> DataFrame:
    """Effects in each cell of unit covariates; ``units``: (unit, covariates...), one row for each unit."""
    return effects(counterfactuals.join(units, "unit"), control, covariates)


def cate_cube(counterfactuals: DataFrame, units: DataFrame, covariates: list[str], control: str) -> DataFrame:
    """Effects in all margins of the covariates; NULL stands for all."""
    w = Window.partitionBy("unit", "time")
    d = counterfactuals.join(units, "unit").withColumn("diff", F.col("value") - F.max(F.when(F.col("action") == control, F.col("value"))).over(w)).where(F.col("action") != control)
    return d.cube(*covariates, "action").agg(F.avg("diff").alias("effect")).where("action is not null")


def unit_covariates(panel: DataFrame, covariates: list[str]) -> DataFrame:
    """(unit, covariates...): the least value of each where rows of a unit disagree."""
    return panel.groupBy("unit").agg(*[F.min(c).alias(c) for c in covariates])


def group_means(panel: DataFrame) -> DataFrame:
    """(action, n, mean_metric)."""
    return panel.groupBy("action").agg(F.count("metric").alias("n"), F.avg("metric").alias("mean_metric"))


def naive_ate(panel: DataFrame, control: str) -> DataFrame:
    """(action, effect): mean of each action's outcomes less the control's."""
    means = group_means(panel)
    base = means.where(F.col("action") == control).select(F.col("mean_metric").alias("base"))
    return means.where(F.col("action") != control).crossJoin(F.broadcast(base)).select("action", (F.col("mean_metric") - F.col("base")).alias("effect"))  # one row


def _less_control(outcomes: DataFrame, control: str, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return outcomes.withColumn("effect", F.col("outcome") - F.max(F.when(F.col("action") == control, F.col("outcome"))).over(w)).where(F.col("action") != control)


def ipw_saturated(panel: DataFrame, covariates: list[str], control: str, by: list[str] | None = None) -> DataFrame:
    """(by..., action, outcome, effect): weights are inverse frequencies of actions in covariate cells.

    With saturated covariates the maximum-likelihood propensity is the cell's frequency; outcomes are
    weighted means (Hajek). Cells are aggregated before they are weighted, so only cell sums move.
    """
    by = by or []
    cells = panel.groupBy(*by, *covariates, "action").agg(F.count("metric").alias("n"), F.sum("metric").alias("total")).where("n > 0")
    of = F.sum("n").over(Window.partitionBy(*by, *covariates))
    outcome = cells.withColumn("w", of / F.col("n")).groupBy(*by, "action").agg((F.sum(F.col("w") * F.col("total")) / F.sum(F.col("w") * F.col("n"))).alias("outcome"))
    return _less_control(outcome, control, by).select(*by, "action", "outcome", "effect")


def dr_saturated(panel: DataFrame, covariates: list[str], control: str) -> DataFrame:
    """(covariates..., action, effect): cell means, which with saturated models are doubly robust."""
    cells = panel.groupBy(*covariates, "action").agg(F.avg("metric").alias("outcome"))
    return _less_control(cells, control, covariates).select(*covariates, "action", "effect").where("effect is not null")


def _features(covariates: list[str], out: str = "features") -> list:
    index = StringIndexer(inputCols=covariates, outputCols=[f"{c}_i" for c in covariates], handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in covariates], outputCols=[f"{c}_v" for c in covariates])
    return [index, hot, VectorAssembler(inputCols=[f"{c}_v" for c in covariates], outputCol=out)]


def propensities(panel: DataFrame, covariates: list[str], learner: str = "logistic", seed: int = 0) -> DataFrame:
    """``panel`` with ``propensity`` of the action taken given covariates, by a pyspark.ml classifier."""
    text = panel.where("metric is not null and action is not null").select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"x_{c}") for c in covariates])
    names = [f"x_{c}" for c in covariates]
    label = StringIndexer(inputCol="action", outputCol="label")
    model = LogisticRegression(maxIter=100) if learner == "logistic" else RandomForestClassifier(seed=seed)
    fitted = Pipeline(stages=[*_features(names), label, model]).fit(text).transform(text)
    p = F.element_at(vector_to_array("probability"), (F.col("label") + 1).cast("int"))
    return fitted.withColumn("propensity", p).select(*panel.columns, "propensity")


def ipw(panel: DataFrame, covariates: list[str], control: str, learner: str = "logistic", seed: int = 0) -> DataFrame:
    """(action, outcome, effect) by inverse propensity weighting; a single action is its own plain mean."""
    actions = [r[0] for r in panel.where("action is not null").select("action").distinct().limit(2).collect()]
    if len(actions) < 2:
        return panel.groupBy("action").agg(F.avg("metric").alias("outcome")).withColumn("effect", F.lit(0.0))
    d = propensities(panel, covariates, learner, seed).withColumn("w", 1 / F.col("propensity"))
    return _less_control(d.groupBy("action").agg((F.sum(F.col("w") * F.col("metric")) / F.sum("w")).alias("outcome")), control)


def doubly_robust(panel: DataFrame, covariates: list[str], control: str, outcome_model: str = "forest", seed: int = 0) -> DataFrame:
    """(covariates..., action, effect): outcome regression weighted by inverse propensities, for each cell."""
    d = propensities(panel, covariates, "logistic", seed).withColumn("w", 1 / F.col("propensity"))
    names = [f"x_{c}" for c in covariates] + ["x_action"]
    text = lambda t: t.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(f"x_{c}") for c in [*covariates, "action"]])
    if outcome_model == "forest":
        # trees have no use for weights below one
        model = RandomForestRegressor(labelCol="metric", weightCol="w", seed=seed)
    else:
        model = LinearRegression(labelCol="metric", weightCol="w")
    fitted = Pipeline(stages=[*_features(names), model]).fit(text(d))
    # distinct covariate cells by actions: both are small sets of categories
    cells = panel.select(*covariates).distinct().crossJoin(F.broadcast(panel.where("action is not null").select("action").distinct()))
    outcome = fitted.transform(text(cells)).select(*covariates, "action", F.col("prediction").alias("outcome"))
    return _less_control(outcome, control, covariates).select(*covariates, "action", "effect")


def absolute_errors(estimates: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """|estimate - truth| of ``effect`` for each key."""
    return estimates.select(*keys, F.col("effect").alias("a")).join(truth.select(*keys, F.col("effect").alias("b")), keys).select(*keys, F.abs(F.col("a") - F.col("b")).alias("abs_error"))
