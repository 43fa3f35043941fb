"""Record streams derived from the driver's tables, so that the engine's operators have something to run on.

The SQL text of each view is the same for Spark and DuckDB but for the conversion of a timestamp to milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EPOCH_MS = 1_704_067_200_000
SPARK_MS, DUCK_MS = "unix_millis(CAST(ts AS TIMESTAMP))", "(epoch_us(ts) // 1000)"

#: {ms} stands for the conversion.
VIEWS = {
    "obs": """SELECT event_id AS seq, user_id % 4 AS camera, concat(CAST(user_id AS VARCHAR(20)), '-', CAST({day} AS VARCHAR(20))) AS track_id,
  event_type AS class_name, {ms} - 1704067200000 AS t, (event_id % 97) / 97.0e0 AS conf, ((event_id * 37) % 900) / 1000.0e0 AS x, ((event_id * 53) % 900) / 1000.0e0 AS y, 1e-1 AS w, 1e-1 AS h FROM events""",
    "trajectories": """SELECT event_id, user_id AS track_id, event_type AS class_name, {ms} - 1704067200000 AS t, CAST(floor(value * 1000) AS BIGINT) AS dwell, (event_id % 30) / 10.0e0 AS velocity,
  17e0 + ((event_id * 37) % 1000) / 1000.0e0 AS lat, 78e0 + ((event_id * 53) % 1000) / 1000.0e0 AS lng FROM events""",
    "memory_events": """SELECT event_id, user_id % 4 AS camera, user_id % 3 AS job, {ms} - 1704067200000 AS start_ms, {ms} - 1704067200000 + 1000 + (event_id * 7919) % 15000 + CASE WHEN event_id % 50 = 0 THEN 3600000 ELSE 0 END AS end_ms, value AS quality FROM events""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_text(name: str, spark: bool) -> str:
    text, ms = VIEWS[name], SPARK_MS if spark else DUCK_MS
    day = f"({ms} div 86400000)" if spark else f"({ms} // 86400000)"
    return text.replace("{ms}", ms).replace("{day}", day)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(sql_text(name, True).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL of a query over some views. A body that starts with WITH goes on with its own."""
    heads = ", ".join(f"{n} AS ({sql_text(n, False)})" for n in names)
    return f"WITH RECURSIVE {heads}" + (f", {body.lstrip()[4:]}" if body.lstrip().startswith("WITH") else f" {body}")
