"""The event table as trajectories, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENTS_SQL = """select user_id % 10 as cohort, user_id, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / CAST(1000000 AS DOUBLE) as t,
 value / 500.0::double as x, CAST(json_extract_string(props, '$.k') AS INT) / 100.0::double as y, event_type as aoi,
 CAST(100 + (event_id * 7919) % 400 AS DOUBLE) as duration, CAST(1 + (event_id * 104729) % 50 AS DOUBLE) / 10.0::double as dispersion from events"""


def event_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cohort, user_id, event_id, t (seconds), x, y, aoi, duration (milliseconds), dispersion."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "user_id % 10 as cohort", "user_id", "event_id", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) / CAST(1000000 AS DOUBLE) as t", "value / 500.0D as x",
        "CAST(get_json_object(props, '$.k') AS INT) / 100.0D as y", "event_type as aoi", "CAST(100 + (event_id * 7919) % 400 AS DOUBLE) as duration", "CAST(1 + (event_id * 104729) % 50 AS DOUBLE) / 10.0D as dispersion",
    )
