"""The streaming twin of rule analytics: state for each track, and what follows from its end.

Zone and line events come as soon as a track is confirmed, in order of arrival. A control row ends a track (`end`: its dwell
event and its summary follow, with the class that most confidence speaks for; then its state goes) or resets it (`reset`:
its state goes silently). A time that runs backwards within a track is an error; equal times pass.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import Policy
from ..operators.sequences import MaskTracker

COLUMNS = ["camera", "track_id", "t", "seq", "event_type", "zone_id", "line_id", "direction", "class_name"]
OUTPUT = "camera long, track_id string, t long, seq long, event_type string, zone_id string, line_id string, direction string, class_name string"


def _inside(x: float, y: float, points: list[tuple[float, float]]) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        if abs(by - ay) > 1.1920929e-07 and (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return len(points) >= 3 and odd


def observe(state: dict, policy: Policy, row) -> list[tuple]:
    """The events of one observation, and those that waited for the track's confirmation. Changes state."""
    if state.setdefault("t", row.t) > row.t:
        raise ValueError(f"time runs backwards in track {row.track_id}: {row.t} after {state['t']}")
    state["t"], state["n"], state["seq"] = row.t, state.get("n", 0) + 1, row.seq
    state.setdefault("t0", row.t)
    votes = state.setdefault("votes", {})
    votes[row.class_name] = votes.get(row.class_name, 0.0) + row.conf
    x, y = row.x + row.w / 2, row.y + row.h / 2
    zones: dict[str, list] = {}
    for z in policy.zones:
        zones.setdefault(z.id, []).append(z)
    was = set(state.get("zones", []))
    now = {zid for zid, parts in zones.items() if any(_inside(x, y, z.points) for z in parts)}
    head = (row.camera, row.track_id, row.t, row.seq)
    out = [(*head, "restricted_zone_occupied" if zones[z][0].restricted else "object_entered_zone", z, None, None, row.class_name) for z in sorted(now - was)]
    out += [(*head, "object_exited_zone", z, None, None, row.class_name) for z in sorted(was - now)]
    state["zones"] = sorted(now)
    state["visited"] = sorted(now | set(state.get("visited", [])))
    sides = state.setdefault("sides", {})
    for ln in policy.lines:
        side = (ln.end[0] - ln.start[0]) * (y - ln.start[1]) - (ln.end[1] - ln.start[1]) * (x - ln.start[0])
        before = sides.get(ln.id)
        if before is not None and abs(before) > 1e-4 and abs(side) > 1e-4 and (before > 0) != (side > 0):
            out.append((*head, "line_crossed", None, ln.id, ln.inbound if before > 0 else ln.outbound, row.class_name))
        sides[ln.id] = side
    waiting = [tuple(e) for e in state.pop("waiting", [])] + out
    if state["n"] >= max(policy.confirmation, 1):
        return waiting
    state["waiting"] = waiting
    return []


def finish(state: dict, policy: Policy, camera: int, track: str) -> list[tuple]:
    """What the end of a track adds: its dwell event, and a row of its class by confidence."""
    if state.get("n", 0) < max(policy.confirmation, 1):
        return []
    best = min(state["votes"], key=lambda c: (-round(state["votes"][c], 9), c))
    head = (camera, track, state["t"], state["seq"])
    dwell = [(*head, "dwell_threshold_exceeded", next(iter(state["visited"]), None), None, None, best)] if state["t"] - state["t0"] >= policy.dwell_ms else []
    return [*dwell, (*head, "track_ended", None, None, None, best)]


def events(observations: DataFrame, policy: Policy) -> DataFrame:
    """A streaming frame of events. observations: camera, track_id, class_name, t, seq, conf, x, y, w, h, and control if rows
    may end or reset a track."""
    rows = observations if "control" in observations.columns else observations.withColumn("control", F.lit(None).cast("string"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(group.get[0]) if group.exists else {}
        out: list[tuple] = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():  # by arrival, so that times running backwards show
            if r.control in ("end", "reset"):
                out += finish(state, policy, *key) if r.control == "end" else []
                state = {}
            else:
                out += observe(state, policy, r)
        if state:
            group.update((json.dumps(state),))
        elif group.exists:
            group.remove()
        yield pd.DataFrame(out, columns=COLUMNS)

    return rows.groupBy("camera", "track_id").applyInPandasWithState(step, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)


def masks(frames: DataFrame, **how) -> DataFrame:
    """A streaming frame of privacy masks for each scope. frames: scope, t, seq, detections (array of struct x, y, w, h, conf),
    and control, where `reset` drops a scope's state; times must increase strictly."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        tracker, last, out = MaskTracker(**how), None, []
        if group.exists:
            last, tracker.next_id, tracks = json.loads(group.get[0])
            tracker.load(tracks)
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if r.control == "reset":
                tracker, last = MaskTracker(**how), None
                continue
            if last is not None and r.t <= last:
                raise ValueError(f"times must increase strictly within scope {key[0]}: {r.t} after {last}")
            last = int(r.t)
            for m in tracker.frame([([d["x"], d["y"], d["w"], d["h"]], d["conf"]) for d in r.detections]):
                out.append((key[0], last, m["mask_id"], *map(float, m["box"]), float(m["conf"]), m["occlusion_frames"]))
        group.update((json.dumps((last, tracker.next_id, tracker.dump())),))
        yield pd.DataFrame(out, columns=["scope", "t", "mask_id", "x", "y", "w", "h", "conf", "occlusion_frames"])

    kind = frames.schema["scope"].dataType.simpleString()
    return frames.groupBy("scope").applyInPandasWithState(step, f"scope {kind}, t bigint, mask_id int, x double, y double, w double, h double, conf double, occlusion_frames int", "state string", "append", GroupStateTimeout.NoTimeout)


def anomalies(scores: DataFrame, smooth: int = 8, run: int = 5, threshold: float = 0.5, gate: float = 0.3) -> DataFrame:
    """A streaming frame of smoothed scores and alerts. scores: scope, t, seq, first, raw: a frame passes if its first score
    reaches the gate; the mean of the last `smooth` scores, 0 for those that didn't pass, and `run` high ones in a row alert."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        recent, count, last = json.loads(group.get[0]) if group.exists else ([], 0, None)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            if last is not None and r.t <= last:
                raise ValueError(f"times must increase strictly within scope {key[0]}: {r.t} after {last}")
            last, passed = int(r.t), bool(r.first >= gate)
            recent = [*recent, float(r.raw) if passed else 0.0][-smooth:]
            mean = sum(recent) / len(recent)
            count = count + 1 if passed and r.raw >= threshold else 0
            out.append((key[0], int(r.seq), mean if passed else 0.0, count, count >= run and mean >= threshold))
        group.update((json.dumps((recent, count, last)),))
        yield pd.DataFrame(out, columns=["scope", "seq", "smoothed", "run", "alert"])

    kind = scores.schema["scope"].dataType.simpleString()
    return scores.groupBy("scope").applyInPandasWithState(step, f"scope {kind}, seq bigint, smoothed double, run int, alert boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def hourly(events_: DataFrame, time: str = "time", grace: str = "3 minutes") -> DataFrame:
    """Counts by hour and type of a streaming frame, final once an hour and the grace are over; later rows are dropped."""
    rows = events_.withWatermark(time, grace).groupBy(F.window(time, "1 hour"), "event_type").agg(F.count("*").alias("events"))
    return rows.select(F.col("window.start").alias("hour"), "event_type", "events")
