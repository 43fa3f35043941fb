"""Thresholds from recent activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(values)
    at = lambda k: F.get(s, F.floor(k).cast("int"))
    return (at((n - 1) / 2) + at(n / 2)) / 2


def adaptive_threshold(frames: DataFrame, key: str, activity: str = "activity", memory: int = 60) -> DataFrame:
    """frames with threshold: median + max(0.05, 3.5 times the median deviation) of the key's last activities, within
    0.10 to 0.55; 0.18 for fewer than four."""
    past = F.collect_list(activity).over(Window.partitionBy(key).orderBy("t", "seq").rowsBetween(-memory, -1))
    rows = frames.withColumn("past", past)
    rows = rows.withColumn("mid", median(F.col("past")))
    spread = median(F.transform("past", lambda v: F.abs(v - F.col("mid"))))
    limit = F.least(F.lit(0.55), F.greatest(F.lit(0.10), F.col("mid") + F.greatest(F.lit(0.05), 3.5 * spread)))
    return rows.withColumn("threshold", F.when(F.size("past") < 4, 0.18).otherwise(limit)).drop("past", "mid")
