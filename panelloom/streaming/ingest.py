"""Structured Streaming: raw events to panel cells, cells into a model, cumulative sums by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from panelloom.plans.model import PanelModel
from panelloom.sources.scratch import move, new_path
from panelloom.spec import PanelSpec


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over Parquet files of events, with ``ts`` as a timestamp that can carry a watermark.

    Unless ``files_per_batch`` is given, all files that are there are one batch; ``arriving`` deals a table out in time.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    # as a pattern, a path may be one file or a folder of files
    return reader.parquet(f"{folder}/{{{name}}}").withColumn("ts", F.col("ts").cast("timestamp"))


def arriving(spark: SparkSession, path: str, folder: str, first: int, days: int) -> Iterator[str]:
    """Let a table of events come in order of time: ``first`` days into ``folder``, then ``days`` more in each step.

    The path of what has come is given after each step, so that a stream over it can catch up before the next.
    Days are counted from the first event's; events without ``ts`` come first.
    """
    events = spark.read.parquet(path)
    day = F.to_date("ts")
    start = events.agg(F.min(day)).first()[0]
    age = F.datediff(day, F.lit(start).cast("date"))
    part = F.when(age >= first, F.floor((age - first) / days) + 1).otherwise(0).cast("int")
    parts = f"{folder}-parts"
    events.withColumn("part", part).write.partitionBy("part").parquet(parts)
    for row in spark.read.parquet(parts).select("part").distinct().orderBy("part").collect():
        # under another name, as the part is no column of the stream
        move(spark, f"{parts}/part={row['part']}", f"{folder}/{row['part']:06d}")
        yield f"{folder}/*"


def panel_cells(events: DataFrame, unit: str = "user_id", action: str = "event_type", value: str = "value", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(unit, time, action, metric) of closed windows: a cell leaves the stream once it is final."""
    d = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col(unit).alias("unit"))
    d = d.agg(F.max_by(action, "ts").alias("action"), F.sum(value).alias("metric"))
    return d.select("unit", F.to_date("window.start").alias("time"), "action", F.round("metric", 2).alias("metric"))


class ModelSink:
    """foreachBatch sink that fits a model on its first batch and appends later ones.

    Each batch leaves its cells, a model, its late rows and at last a state under names of its own below ``path``
    (``cells/batch=<batch>``, ``model-<batch>``, ``late/batch=<batch>``, ``state/batch=<batch>``). The state is one
    committed file, so a batch counts when that is there; what a failed try left is written over by the next, and a
    batch that is replayed after it was done is skipped.

    As an append can't bring new units, a batch that has some is fitted with all cells so far, in one regime; of rows
    of the same cell, the first batch's count.
    """

    def __init__(self, model: PanelModel, spec: PanelSpec, path: str) -> None:
        self.model, self.spec, self.path = model, spec, path
        self.batch = -1  # the batch after which self.model stands

    def _done(self, spark: SparkSession) -> dict:
        """The last complete state."""
        try:
            states = [json.loads(r[0]) for r in spark.read.text(f"{self.path}/state/*").collect()]
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            states = []
        return max(states, key=lambda s: s["batch"], default={"batch": -1, "version": None})

    def _strangers(self, batch: DataFrame) -> bool:
        """Whether a batch has units that the model doesn't know."""
        units = batch.select(F.col(self.spec.unit).alias("unit")).where("unit is not null")
        return not units.join(self.model.tables["units"], "unit", "left_anti").isEmpty()

    def _cells(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """All cells up to a batch."""
        schema = StructType([*batch.schema, StructField("batch", IntegerType())])
        cells = batch.sparkSession.read.schema(schema).option("basePath", f"{self.path}/cells").parquet(f"{self.path}/cells").where(F.col("batch") <= batch_id)
        first = F.rank().over(Window.partitionBy(self.spec.unit, self.spec.time).orderBy("batch"))
        return cells.withColumn("at", first).where("at = 1").drop("at", "batch")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._done(spark)
        if batch_id <= done["batch"]:
            return
        if done["version"] and self.batch != done["batch"]:
            # a new process, or a try of this batch that failed half way
            self.model = PanelModel.load(spark, f"{self.path}/{done['version']}")
        elif not done["version"] and self.model.spec is not None and self.batch != done["batch"]:
            self.model = PanelModel(spark, self.model.config)
        version = done["version"]
        # unless it is kept, each use of a batch runs its stream's aggregation again
        place = f"{self.path}/cells/batch={batch_id}"
        batch.write.mode("overwrite").parquet(place)
        batch = spark.read.schema(batch.schema).parquet(place)
        if not batch.isEmpty():
            self.batch = None  # not to be trusted until the state is written
            if self.model.spec is None:
                self.model.fit(batch, self.spec)
            elif self._strangers(batch):
                self.model = PanelModel(spark, self.model.config).fit(self._cells(batch, batch_id), self.spec)
            else:
                self.model.partial_fit(batch)
                if self.model.late is not None:
                    self.model.late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch_id}")
            version = f"model-{batch_id}"
            self.model.save(f"{self.path}/{version}")
        state = json.dumps({"batch": batch_id, "version": version})
        spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/state/batch={batch_id}")
        self.batch = batch_id


def stream_into(cells: DataFrame, sink: ModelSink, checkpoint: str) -> StreamingQuery:
    """Start feeding cells into a model's sink with all that is available now."""
    return cells.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CUSUM = "unit long, n long, cusum double"


def keyed_cusum(events: DataFrame, drift: float, unit: str = "user_id", value: str = "value") -> DataFrame:
    """(unit, n, cusum) after each batch: c = max(c + value - drift, 0) over each key's events in time order.

    The state is two numbers a key; events of a batch are ordered by time within their key.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, c = state.get if state.exists else (0, 0.0)
        # two numbers an event of a key and batch; batches are bounded by the reader
        parts = [(f["ts"].to_numpy(), f["value"].to_numpy(float)) for f in frames]
        ts, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        v = v[np.argsort(ts, kind="stable")]
        v = v[~np.isnan(v)]
        if len(v):
            s = c + np.cumsum(v - drift)
            c, n = float(s[-1] - min(0.0, s.min())), n + len(v)
        state.update((n, c))
        yield pd.DataFrame({"unit": [key[0]], "n": [n], "cusum": [c]})

    d = events.select(F.col(unit).alias("unit"), "ts", F.col(value).cast("double").alias("value"))
    return d.groupBy("unit").applyInPandasWithState(run, CUSUM, "n long, c double", "update", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame) -> DataFrame:
    """Run an appending stream over all that is available; its rows as a table in the shared folder."""
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def updates_table(stream: DataFrame) -> DataFrame:
    """Run an updating stream over all that is available; its updates with the number of their ``batch``.

    Each batch is written under its number, over what a failed try of it may have left.
    """
    spark = stream.sparkSession
    path = new_path(spark, "stream")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/rows/batch=-1")  # a stream without data has no batches
    write = lambda rows, k: rows.write.mode("overwrite").parquet(f"{path}/rows/batch={k}")
    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(StructType([*stream.schema, StructField("batch", IntegerType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last update of each key."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
