"""Sources and sinks of panels, truths and results; panels cut from event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelloom.operators.panel import small_dimension


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A headed CSV with an explicit schema: nothing is inferred."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)


def read_table(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    """Parquet, ORC, JSON, JDBC or any source Spark knows by name."""
    reader = spark.read.format(kind).options(**options)
    return reader.load(path) if path else reader.load()


def from_pandas(spark: SparkSession, frame, partitions: int | None = None) -> DataFrame:
    df = spark.createDataFrame(frame)
    return df.repartition(partitions) if partitions else df


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: int = 7) -> None:
    """A headed CSV folder, doubles rounded."""
    rounded(df, digits).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, digits: int | None = None, partition_by: list[str] | None = None) -> None:
    out = (rounded(df, digits) if digits is not None else df).write.mode("overwrite")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_metrics(rows: DataFrame, path: str) -> None:
    """Results of a harness, rewritten after each step."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def intervention_layout(panel: DataFrame, split: object, times: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(pre, post) wide tables of (unit, time, action, metric): one column for each step.

    pre holds steps before ``split`` under the action first taken; post has a row for each unit and action.
    """
    pre = panel.where(F.col("time") < F.lit(split)).groupBy("unit").pivot("time", None if times is None else [t for t in times if t < split]).agg(F.first("metric"))
    post = panel.where(F.col("time") >= F.lit(split)).groupBy("unit", "action").pivot("time", None if times is None else [t for t in times if t >= split]).agg(F.first("metric"))
    return pre, post


def counterfactual_layout(truth: DataFrame, times: list | None = None) -> DataFrame:
    """All counterfactuals wide: a row for each unit and action."""
    return truth.groupBy("unit", "action").pivot("time", times).agg(F.first("value"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, action, metric): users by day, their last event type, the sum of values."""
    e = _table(spark, sf_dir, "events")
    # the last of numbers is found by hashing, that of strings by sorting all events
    kinds = small_dimension(e, "event_type").select("event_type", "event_type_idx").persist()
    d = e.select("user_id", "ts", "event_type", "value").join(kinds, "event_type", "left")
    d = d.groupBy(F.col("user_id").alias("unit"), F.to_date("ts").alias("time")).agg(F.max_by("event_type_idx", "ts").alias("event_type_idx"), F.round(F.sum("value"), 2).alias("metric"))
    return d.join(kinds, "event_type_idx", "left").select("unit", "time", F.col("event_type").alias("action"), "metric")


def nation_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, action, metric): nations by month, their most frequent order priority, the sum of prices."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    d = o.join(c, "o_custkey").groupBy(F.col("c_nationkey").alias("unit"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("time"), "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return d.groupBy("unit", "time").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("action"), F.round(F.sum("total"), 2).alias("metric"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, time, action, metric, segment, region): orders with their customer's covariates."""
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return o.join(c, "o_custkey").join(n, "n_nationkey").select(F.col("o_custkey").alias("unit"), F.to_date("o_orderdate").alias("time"), F.col("o_orderpriority").alias("action"), F.col("o_totalprice").alias("metric"), F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region"))
