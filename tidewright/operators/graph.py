"""Clip graphs: bounded traversal from anchors, and key frames by relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Bridge edges in both directions; temporal ones stay directed. edges: source, target, kind, weight."""
    back = edges.where("kind = 'bridge'").select(F.col("target").alias("source"), F.col("source").alias("target"), "kind", "weight")
    return edges.unionByName(back)


def traversed(edges: DataFrame, anchors: DataFrame, hops: int = 2, least: float = 0.70) -> DataFrame:
    """node, depth: what is reached from the anchors (node) in at most `hops` steps over edges of enough weight."""
    usable = edges.where(F.col("weight") >= least).select("source", "target").distinct()
    seen = anchors.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for depth in range(1, hops + 1):
        step = front.join(usable, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(front)
    return seen


def relevance(entities: Column, asked: list[str], causal: bool) -> Column:
    score = F.lit(0.5 + (0.10 if causal else 0.0))
    for e in asked:
        score = score + F.when(F.array_contains(entities, e), 0.35).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def keyframes(clips: DataFrame, edges: DataFrame, asked: list[str], causal: bool, hops: int = 2, least: float = 0.70, most: int = 14) -> DataFrame:
    """clip_id, score: the most relevant clips reached from those with an asked entity. clips: clip_id, entities."""
    match = F.lit(not asked) | F.exists("entities", lambda x: F.exists(F.array(*map(F.lit, asked)), lambda e: F.contains(x, e)))
    reached = traversed(edges, clips.where(match).select(F.col("clip_id").alias("node")), hops, least)
    rows = clips.join(reached, F.col("clip_id") == F.col("node"), "left_semi")
    return rows.select("clip_id", F.round(relevance(F.col("entities"), asked, causal), 6).alias("score")).orderBy(F.desc("score"), "clip_id").limit(min(most, 14))
