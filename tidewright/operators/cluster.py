"""Identities across cameras: candidate pairs, scores, optimal assignment and constrained merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import OID, uuid5
from ..functions.vectors import similarity


def relations(edges: DataFrame, cameras: DataFrame, tolerance: int = 1500) -> DataFrame:
    """relation, edge_id, source, target, kind, low, high, edge: the given edges, and all unordered pairs of cameras inside
    each non-empty overlap group. edges: nth (their order), edge_id and the rest; cameras: camera, group. relation sorts
    edges before pairs."""
    given = edges.select(F.concat(F.lit("0:"), F.lpad(F.col("nth").cast("string"), 10, "0")).alias("relation"), "edge_id", "source", "target", "kind", F.col("low").cast("bigint").alias("low"), F.col("high").cast("bigint").alias("high"), F.col("edge").cast("double").alias("edge"))
    one = cameras.where("group <> ''").select("camera", "group").distinct()
    pairs = one.withColumnRenamed("camera", "source").join(one.withColumnRenamed("camera", "target"), "group").where("source < target")
    name = F.concat(F.lit("1:"), "group", F.lit(":"), F.col("source").cast("string"), F.lit(":"), F.col("target").cast("string"))
    made = pairs.select(name.alias("relation"), F.concat(F.lit("overlap-group:"), "group").alias("edge_id"), "source", "target", F.lit("overlap").alias("kind"), F.lit(0).cast("bigint").alias("low"), F.lit(tolerance).cast("bigint").alias("high"), F.lit(1.0).alias("edge"))
    return given.unionByName(made)


def shifted(t: Column, offset: Column) -> Column:
    """A time by a camera's clock offset; never below 0."""
    return F.greatest(t + offset, F.lit(0))


def temporal_score(kind: Column, s0: Column, s1: Column, t0: Column, t1: Column, low: Column, high: Column, tolerance: int) -> Column:
    gap = F.when(s1 < t0, t0 - s1).when(t1 < s0, s0 - t1).otherwise(F.lit(0))
    tol = max(tolerance, 1)
    near = F.when(gap > tol, 0.0).otherwise(1 - gap / tol)
    travel = t0 - s1
    half = F.greatest(high - low, F.lit(1)) / 2
    shape = F.greatest(F.lit(0.05), F.least(F.lit(1.0), 1 - F.abs(travel - (low + high) / 2) / half))
    return F.when(kind == "overlap", near).otherwise(F.when((travel < 0) | (travel < low) | (travel > high), 0.0).otherwise(shape))


def candidates(relations: DataFrame, tracks: DataFrame, least: float = 0.70, tolerance: int = 1500, bucket_ms: int = 60_000) -> DataFrame:
    """Scored pairs of tracks. relations: relation, source, target, kind, low, high, edge. tracks: camera, track_id,
    class_name, t0, t1, conf, prototype.

    Only pairs whose times can score meet: a source track's reach and a target track (its whole time for an overlap, its
    start for a transition) share a bucket of time, the first that both touch.
    """
    s, t = tracks.select([F.col(c).alias(f"s_{c}") for c in tracks.columns]), tracks.select([F.col(c).alias(f"t_{c}") for c in tracks.columns])
    tol = max(tolerance, 1)
    near = F.col("kind") == "overlap"
    at = lambda c: F.floor(c / bucket_ms).cast("bigint")
    reach = relations.join(s, F.col("source") == F.col("s_camera")).withColumns({
        "from": F.when(near, F.col("s_t0") - tol).otherwise(F.col("s_t1") + F.greatest("low", F.lit(0))), "to": F.when(near, F.col("s_t1") + tol).otherwise(F.col("s_t1") + F.col("high")),
    }).where(F.col("from") <= F.col("to")).withColumn("bucket", F.explode(F.sequence(at(F.col("from")), at(F.col("to")))))
    whole = t.withColumn("bucket", F.explode(F.sequence(at(F.col("t_t0")), at(F.greatest("t_t0", "t_t1")))))
    rows = reach.join(whole, (F.col("target") == F.col("t_camera")) & (F.col("s_class_name") == F.col("t_class_name")) & (reach["bucket"] == whole["bucket"]))
    first = F.when(near, F.greatest(at(F.col("from")), at(F.col("t_t0")))).otherwise(at(F.col("t_t0")))
    rows = rows.where(reach["bucket"] == first).drop("bucket", "from", "to")
    rows = rows.withColumn("temporal", temporal_score(F.col("kind"), F.col("s_t0"), F.col("s_t1"), F.col("t_t0"), F.col("t_t1"), F.col("low"), F.col("high"), tolerance)).where("temporal > 0")
    rows = rows.withColumn("appearance", similarity(F.col("s_prototype"), F.col("t_prototype"))).where(F.col("appearance") >= least)
    q = F.sqrt(F.col("s_conf") * F.col("t_conf"))
    overlap = 0.70 * F.col("appearance") + 0.20 * F.col("temporal") + 0.10 * q
    moved = 0.65 * F.col("appearance") + 0.20 * F.col("temporal") + 0.10 * q + 0.05 * F.col("edge")
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(near, overlap).otherwise(moved))))


def hungarian(cost: np.ndarray) -> np.ndarray:
    """For each row of a square matrix the column of a cheapest assignment, by shortest augmenting paths with duals."""
    n = len(cost)
    dual_row, dual_col = np.zeros(n), np.zeros(n + 1)
    owner = np.full(n + 1, -1)
    for row in range(n):
        owner[n] = row
        here, best = n, np.full(n, np.inf)
        back, done = np.full(n, n), np.zeros(n + 1, bool)
        while owner[here] >= 0:
            done[here] = True
            i = owner[here]
            reduced = cost[i] - dual_row[i] - dual_col[:n]
            better = ~done[:n] & (reduced < best)
            best[better], back[better] = reduced[better], here
            open_ = np.where(done[:n], np.inf, best)
            nxt = int(np.argmin(open_))
            step = open_[nxt]
            at = np.flatnonzero(done)
            dual_row[owner[at]] += step
            dual_col[at] -= step
            best[~done[:n]] -= step
            here = nxt
        while here != n:
            owner[here] = owner[back[here]]
            here = back[here]
    out = np.empty(n, int)
    out[owner[:n]] = np.arange(n)
    return out


PAIR = ["relation", "s_camera", "s_track_id", "t_camera", "t_track_id", "score"]


def _parts(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The connected part of each pair of row and column numbers."""
    root = list(range(int(left.max(initial=-1)) + int(right.max(initial=-1)) + 2))

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for a, b in zip(left, right + int(left.max(initial=-1)) + 1, strict=True):
        root[find(int(a))] = find(int(b))
    return np.array([find(int(a)) for a in left])


def assigned(scored: DataFrame, least: float = 0.55) -> DataFrame:
    """The optimal one-to-one pairs of each relation, with the other columns of scored. Pairs that share no track don't
    compete, so each connected part of a relation's pairs is solved by itself, in a matrix of its own size."""

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["s_track_id", "t_track_id"]).reset_index(drop=True)
        left, right = pd.factorize(g["s_track_id"], sort=True)[0], pd.factorize(g["t_track_id"], sort=True)[0]
        keep = np.zeros(len(g), bool)
        for _, rows in pd.Series(range(len(g))).groupby(_parts(left, right)):
            at = rows.to_numpy()
            i, j = np.unique(left[at], return_inverse=True)[1], np.unique(right[at], return_inverse=True)[1]
            n = max(i.max(), j.max()) + 1
            cost = np.ones((n, n))
            cost[: i.max() + 1, : j.max() + 1] = 2.0
            cost[i, j] = 1 - g["score"].to_numpy()[at]
            keep[at] = hungarian(cost)[i] == j
        return g[keep & (g["score"] >= least).to_numpy()]

    return scored.groupBy("relation").applyInPandas(solve, scored.schema)


def decisions(pairs: DataFrame, job: str, final: float = 0.90, provisional: float = 0.75) -> DataFrame:
    """One decision for each unordered pair of tracks, the best score and the first relation among ties: pairs with
    association_id, state and explanation."""
    a, b = (F.struct(F.col(f"{x}_camera").alias("camera"), F.col(f"{x}_track_id").alias("track_id")) for x in "st")
    rank = F.row_number().over(Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy(F.desc("score"), "relation"))
    state = F.when(F.col("score") >= final, "final_match").when(F.col("score") >= provisional, "provisional").otherwise("ambiguous")
    ends = [F.concat_ws(":", F.col(f"{x}_camera").cast("string"), F.col(f"{x}_track_id")) for x in "st"]
    way = F.when(F.col("kind") == "overlap", "overlap").otherwise("directed transition")
    text = F.concat(ends[0], F.lit(" → "), ends[1], F.lit(" through "), way, F.format_string(" evidence; appearance %.3f, temporal %.3f", "appearance", "temporal"))
    return pairs.withColumn("rank", rank).where("rank = 1").drop("rank").withColumns({"association_id": uuid5(OID, F.concat_ws(":", F.lit(job), *ends)), "state": state, "explanation": text})


def merged(tracks: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, camera, track_id, component (its smallest camera:track), association_id, state: a row for each track, with null
    in the last two, and one for each decision, with null in the first two. Decisions are taken by score, ties by id; one
    that would give an identity overlapping tracks in one camera becomes ambiguous. The order matters, so one job's
    tracks meet in one task."""

    def merge(k, t: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["camera", "track_id"]).reset_index(drop=True)
        of = {(c, i): n for n, (c, i) in enumerate(zip(t["camera"], t["track_id"], strict=True))}
        t0, t1, camera = t["t0"].to_numpy(), t["t1"].to_numpy(), t["camera"].to_numpy()
        root = np.arange(len(t))
        group = {n: [n] for n in range(len(t))}
        d = d.sort_values(["score", "association_id"], ascending=[False, True])
        states, spots = [], []
        for r in d.itertuples():
            x, y = of.get((r.s_camera, r.s_track_id)), of.get((r.t_camera, r.t_track_id))
            state = r.state
            if state != "ambiguous" and x is not None and y is not None and root[x] != root[y]:
                a, b = np.array(group[root[x]]), np.array(group[root[y]])
                clash = (camera[a][:, None] == camera[b]) & (t0[a][:, None] <= t1[b]) & (t0[b] <= t1[a][:, None])
                if clash.any():
                    state = "ambiguous"
                else:
                    keep, gone = min(root[x], root[y]), max(root[x], root[y])
                    members = group.pop(gone)
                    root[members] = keep
                    group[keep] += members
            states.append(state), spots.append(x)
        name = [f"{t.camera[r]}:{t.track_id[r]}" for r in root]
        rows = pd.DataFrame({"camera": t["camera"], "track_id": t["track_id"], "component": name, "association_id": None, "state": None})
        taken = pd.DataFrame({"camera": None, "track_id": None, "component": [None if x is None else name[x] for x in spots], "association_id": d["association_id"].to_numpy(), "state": states})
        both = pd.concat([rows, taken], ignore_index=True) if len(taken) else rows
        both.insert(0, key, k[0])
        return both

    schema = f"{key} {tracks.schema[key].dataType.simpleString()}, camera {tracks.schema['camera'].dataType.simpleString()}, track_id string, component string, association_id string, state string"
    return tracks.groupBy(key).cogroup(found.groupBy(key)).applyInPandas(merge, schema)


def identities(tracks: DataFrame, found: DataFrame, merged_: DataFrame, key: str, job: str) -> DataFrame:
    """global_id, state, confidence (the least score of its decisions, else the least track confidence), cameras, segments
    and associations (arrays) of each identity, in order of global_id."""
    member = merged_.where("track_id IS NOT NULL").select(key, "camera", "track_id", "component").join(tracks, [key, "camera", "track_id"])
    segment = F.struct(F.col("t0").alias("started_at_ms"), "camera", "track_id", "class_name", F.col("t1").alias("ended_at_ms"), "conf")
    own = member.groupBy(key, "component").agg(F.sort_array(F.collect_list(segment)).alias("segments"), F.array_sort(F.collect_set("camera")).alias("cameras"), F.min("conf").alias("track_confidence"), F.array_sort(F.collect_list(F.concat_ws(":", F.col("camera").cast("string"), "track_id"))).alias("names"))
    taken = merged_.where("association_id IS NOT NULL AND state <> 'ambiguous'").select(key, "component", "association_id", F.col("state").alias("now")).join(found.select("association_id", "score"), "association_id")
    joined = taken.groupBy(key, "component").agg(F.array_sort(F.collect_list("association_id")).alias("associations"), F.min("score").alias("least"), F.max(F.col("now") == "provisional").alias("provisional"))
    rows = own.join(joined, [key, "component"], "left")
    state = F.when(F.size("cameras") == 1, "observed_single_camera").when(F.coalesce("provisional", F.lit(False)), "provisional_multi_camera").otherwise("observed_multi_camera")
    global_id = uuid5(OID, F.concat(F.lit(f"{job}:"), F.array_join("names", "|")))
    return rows.select(key, global_id.alias("global_id"), state.alias("state"), F.coalesce("least", "track_confidence").alias("confidence"), "cameras", "segments", F.coalesce("associations", F.array().cast("array<string>")).alias("associations")).orderBy("global_id")


def report(cameras: DataFrame, found: DataFrame, merged_: DataFrame, failures: int = 0) -> DataFrame:
    """One row of a job's report. cameras: camera, tracks, events, observations; found and merged_ as above."""
    sums = cameras.agg(F.count("*").alias("cameras"), F.sum("tracks").alias("tracks"), F.sum("events").alias("events"), F.sum("observations").alias("observations"))
    states = merged_.where("association_id IS NOT NULL").agg(F.count("*").alias("decisions"), *[F.count_if(F.col("state") == s).alias(s) for s in ("final_match", "provisional", "ambiguous")])
    ids = merged_.where("track_id IS NOT NULL").agg(F.countDistinct("component").alias("identities"))
    score = found.agg(F.avg("score").alias("mean"))
    rows = sums.join(states, F.lit(True)).join(ids, F.lit(True)).join(score, F.lit(True))
    text = F.format_string("Processed %d confirmed local person tracklets and %d camera events. Produced %d cross-camera decisions: %d final, %d provisional and %d ambiguous. Identity records are not a unique-person count when cameras are unrelated.", "tracks", "events", "decisions", "final_match", "provisional", "ambiguous")
    return rows.select("cameras", "tracks", "events", "observations", "decisions", "final_match", "provisional", "ambiguous", "identities", F.lit(failures).alias("failures"), F.when((F.col("observations") > 0) & (F.col("decisions") > 0), F.round("mean", 6)).alias("confidence"), text.alias("summary"))


def view_descriptions(cameras: DataFrame, most_areas: int = 48) -> DataFrame:
    """One row from all cameras' descriptions. cameras: nth, label, scene_type, description, areas (array), confidence,
    generated, model, fallback."""
    from .memory_query import shortened

    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("nth", c.alias("v")))), lambda x: x["v"])
    part = F.concat("label", F.lit(" ("), "scene_type", F.lit("): "), shortened(F.col("description")))
    named = F.transform("areas", lambda a: F.concat("label", F.lit(": "), a))
    return cameras.agg(
        F.array_join(order(part), " ").alias("description"), F.array_join(F.slice(F.flatten(order(named)), 1, most_areas), "; ").alias("areas"), F.coalesce(F.round(F.avg(F.when(F.col("generated"), F.col("confidence"))), 6), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.max("generated"), F.lit(False)).alias("generated"), F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("generated"), F.col("model")))), ", "), F.lit("")).alias("model"),
        F.nullif(F.array_join(F.filter(order(F.concat("label", F.lit(": "), "fallback")), lambda x: x.isNotNull()), "; "), F.lit("")).alias("fallback"),
    )
