"""Registered streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.plans.model import PanelModel
from panelloom.plans.queries import P1, SMALL, SPEC, query
from panelloom.sources.scratch import new_path
from panelloom.streaming.ingest import ModelSink, arriving, keyed_cusum, latest, panel_cells, read_events, stream_into, to_table, updates_table


@query(f"WITH {P1} SELECT * FROM p1 WHERE CAST(time AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def streaming_panel_cells(spark, sf_dir):
    return to_table(panel_cells(read_events(spark, f"{sf_dir}/events.parquet")))


@query("""WITH s AS (SELECT user_id AS unit, ts, count(*) OVER w AS n, sum(value - 60) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)),
c AS (SELECT unit, n, ts, s - least(0, min(s) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS c FROM s)
SELECT unit, max(n)::BIGINT AS n, round(arg_max(c, ts), 4) AS cusum FROM c GROUP BY unit""")
def streaming_cusum(spark, sf_dir):
    d = latest(updates_table(keyed_cusum(read_events(spark, f"{sf_dir}/events.parquet"), 60.0)), "unit")
    return d.select("unit", "n", F.round("cusum", 4).alias("cusum"))


@query()
def streaming_partial_fit(spark, sf_dir):
    """Twenty-four days are fitted, as far as they are final, the rest is appended three days at a time."""
    folder = new_path(spark, "stream-model")
    sink = ModelSink(PanelModel(spark, SMALL), SPEC, f"{folder}/model")
    for events in arriving(spark, f"{sf_dir}/events.parquet", f"{folder}/events", 24, 3):
        stream_into(panel_cells(read_events(spark, events)), sink, f"{folder}/checkpoint").awaitTermination()
    return sink.model.summary()
