"""Queries that walk a sequence and have no oracle, on the whole of sf0.001, against plain Python."""

import collections
import itertools

import numpy as np
import pytest

from tidewright.operators import sequences
from tidewright.plans import frames, operations

SF = "/root/testdata/sf0.001"


def plain_events(rows):
    """One event after the other, frame by frame; rows: (t, activity, quality, threshold) by time."""
    out, members, start = [], [], 0
    for t, activity, quality, limit in rows:
        if members and len(out) < 47 and ((activity >= limit and t - start >= 2000) or t - start >= 15_000):
            out.append((start, t, members, "novelty" if activity >= limit and t - start >= 2000 else "maximum_duration"))
            members, start = [], t
        members.append((t, activity, quality))
    out.append((start, round(rows[-1][0] + 40), members, "stream_end"))
    told = []
    for n, (a, z, own, why) in enumerate(out):
        best = max(own, key=lambda m: m[2])
        told.append((n, a, z, round(sum(m[1] for m in own) / len(own), 9), max(m[1] for m in own), best[2], best[0], "stream_start" if n == 0 else why))
    return told


@pytest.fixture(scope="module")
def sampled(spark):
    rows = collections.defaultdict(list)
    for r in frames._frames(spark, SF).orderBy("camera", "t").collect():
        rows[r.camera].append((r.t, float(r.activity), float(r.quality), r.threshold))
    return rows


def test_segments_of_all_frames(spark, sampled):
    got = collections.defaultdict(list)
    for r in frames.event_segmentation(spark, SF).orderBy("camera", "event").collect():
        got[r.camera].append((r.event, r.start_ms, r.end_ms, round(r.activity_mean, 9), r.activity_peak, r.quality, r.best_ms, r.boundary_reason))
    assert got == {c: plain_events(rows) for c, rows in sampled.items()}


def test_segments_of_few_frames(spark):
    for rows in ([(0, 0.9, 0.5, 0.1)], [(k * 100, 0.9, 0.1 * (k % 3), 0.5) for k in range(200)], [(k * 16_000, 0.0, 0.0, 0.5) for k in range(60)], [(0, 0.0, 0.2, 0.1), (0, 0.5, 0.1, 0.1), (3000, 0.5, 0.3, 0.1)]):
        df = spark.createDataFrame([("s", *r) for r in rows], "source string, t long, activity double, quality double, threshold double")
        got = [(r.event, r.start_ms, r.end_ms, round(r.activity_mean, 9), r.activity_peak, r.quality, r.best_ms, r.boundary_reason) for r in sequences.segmented(df, "source").orderBy("event").collect()]
        assert got == plain_events(rows)


def test_diverse_choices_of_all_events(spark, sampled):
    got = collections.defaultdict(set)
    for r in frames.diverse_selection(spark, SF).collect():
        got[r.camera].add(r.event)
    for camera, rows in sampled.items():
        events = plain_events(rows)
        mean = {e[0]: e[3] for e in events}
        sign = {n: np.array([m, np.sqrt(max(0.0, 1 - m * m))]) for n, m in mean.items()}
        rank = {e[0]: e[4] + 0.15 * e[5] for e in events}
        chosen = [max(events, key=lambda e: (e[5], e[0]))[0]]
        while len(chosen) < min(6, len(events)):
            novel = lambda n: min(min(1.0, max(0.0, 1 - float(sign[n] @ sign[c]))) for c in chosen)  # noqa: B023, E731
            left = [e[0] for e in events if e[0] not in chosen]
            chosen.append(max(left, key=lambda n: (rank[n] + (0.25 * novel(n) if len(chosen) > 1 else 0), n)))
        assert got[camera] == set(chosen), camera


def test_agreement_of_all_frames(spark):
    pairs = operations._pairs(spark, SF).collect()

    def overlap(p, q):
        w = max(0.0, min(p.x + p.w, q.x + q.w) - max(p.x, q.x))
        h = max(0.0, min(p.y + p.h, q.y + q.h) - max(p.y, q.y))
        return w * h / (p.w * p.h + q.w * q.h - w * h)

    f = lambda row: type("Box", (), {k: float(v) if k != "class_name" else v for k, v in row.asDict().items()})()
    want = collections.defaultdict(lambda: [0, 0, 0, 0, 0.0])
    for row in pairs:
        a, b = [f(x) for x in row.a], [f(x) for x in row.b]
        want[row.camera][0] += 1
        want[row.camera][1] += len(a)
        want[row.camera][2] += len(b)
        ranked = sorted(((overlap(p, q), i, j) for (i, p), (j, q) in itertools.product(enumerate(a), enumerate(b)) if p.class_name == q.class_name), reverse=True)
        left, right = set(), set()
        for s, i, j in ranked:
            if s >= 0.5 and i not in left and j not in right:
                left.add(i), right.add(j)
                want[row.camera][3] += 1
                want[row.camera][4] += s
    for r in operations.detector_agreement(spark, SF).collect():
        n = want[r.camera]
        assert (r.frames, r.left, r.right, r.matched) == tuple(n[:4]) and abs(r.mean_iou - n[4] / n[3]) < 1e-5
