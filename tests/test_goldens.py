"""Small cases with known results."""

import itertools
import random
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewright.functions import cells, ids, vectors
from tidewright.operators import cluster, retrieval, rules, sequences
from tidewright.sources import records
from tidewright.streaming import rules_stream


def test_sample_events(spark):
    obs = records.sample(spark).withColumn("camera", F.lit(0).cast("bigint"))
    got = [(r.t, r.track_id, r.event_type, r.event_id) for r in rules.events(rules.validated(obs), rules.SAMPLE_POLICY, ["camera"]).orderBy("t", "track_id", "emit_ordinal").collect()]
    assert got == [
        (500, "vehicle-001", "restricted_zone_occupied", "1077387d-7dd4-560e-b6df-42200349b841"),
        (3000, "person-001", "line_crossed", "06164ac9-692f-5c7a-bd0d-879b696342f0"),
        (3200, "vehicle-001", "object_exited_zone", "4eced462-8bba-5c7b-a2c1-4bad95eaef73"),
        (4000, "person-001", "restricted_zone_occupied", "7af8b0c8-2159-52e5-8746-74ce9b1f978f"),
        (4100, "vehicle-001", "line_crossed", "ea5c59c7-4d42-510a-8dc2-52056ee90cd1"),
        (5000, "person-001", "dwell_threshold_exceeded", "6e49bd68-c220-5732-8e20-0fdfbae8a5a8"),
    ]


def test_stream_equals_batch(spark, tmp_path):
    obs = records.sample(spark).withColumn("camera", F.lit(0).cast("bigint"))
    obs.repartition(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).json(str(tmp_path / "in"))
    query = rules_stream.events(stream, rules.SAMPLE_POLICY).writeStream.format("memory").queryName("twin").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ["track_id", "t", "event_type", "zone_id", "line_id", "direction"]
    batch = rules.events(obs, rules.SAMPLE_POLICY, ["camera"]).where("phase < 3").select(names)
    assert sorted(map(str, spark.table("twin").select(names).collect())) == sorted(map(str, batch.collect()))


def test_hungarian_against_all_permutations():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 6):
        for _ in range(20):
            cost = rng.random((n, n))
            pick = cluster.hungarian(cost)
            assert sorted(pick) == list(range(n))
            best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(cost[np.arange(n), pick].sum() - best) < 1e-9


def test_merging_never_overlaps_one_camera(spark):
    tracks = spark.createDataFrame([(0, "a", "1", 0, 10), (0, "b", "1", 0, 10), (0, "a", "2", 5, 15)], "job int, camera string, track_id string, t0 long, t1 long")
    decided = spark.createDataFrame([(0, "a", "1", "b", "1", 0.95, "final_match", "x"), (0, "a", "2", "b", "1", 0.91, "final_match", "y")], "job int, s_camera string, s_track_id string, t_camera string, t_track_id string, score double, state string, association_id string")
    rows = cluster.merged(tracks, decided, "job").collect()
    assert {(r.camera, r.track_id): r.component for r in rows if r.track_id} == {("a", "1"): "a:1", ("b", "1"): "a:1", ("a", "2"): "a:2"}
    assert {r.association_id: r.state for r in rows if r.association_id} == {"x": "final_match", "y": "ambiguous"}


def test_assignment_by_parts_against_all_choices(spark):
    rng = np.random.default_rng(1)
    rows = [(r, "a", f"s{i}", "b", f"t{j}", float(s)) for r in range(12) for i in range(4) for j in range(3) if (s := rng.random()) > 0.45]
    got = {}
    for r in cluster.assigned(spark.createDataFrame(rows, "relation int, s_camera string, s_track_id string, t_camera string, t_track_id string, score double"), 0.0).collect():
        got.setdefault(r.relation, []).append((r.s_track_id, r.t_track_id, r.score))
    for rel in range(12):
        own = [(x[2], x[4], x[5]) for x in rows if x[0] == rel]
        choices = [c for n in range(4) for c in itertools.combinations(own, n) if len({x[0] for x in c}) == n and len({x[1] for x in c}) == n]
        best = max(sum(1 + x[2] for x in c) for c in choices)
        mine = got.get(rel, [])
        assert len({x[0] for x in mine}) == len(mine) == len({x[1] for x in mine}) and abs(sum(1 + x[2] for x in mine) - best) < 1e-9


def test_identities_against_a_plain_merge(spark):
    rng = random.Random(3)
    tracks = [(0, rng.choice("abc"), f"t{k}", "person", s, s + rng.randrange(30), 0.5 + rng.random() / 2) for k in range(40) for s in [rng.randrange(100)]]
    pairs = [(0, a[1], a[2], b[1], b[2], round(rng.random(), 3), rng.choice(["final_match", "provisional", "ambiguous"]), f"id{n:03d}") for n, (a, b) in enumerate(rng.sample(list(itertools.combinations(tracks, 2)), 60)) if a[1] != b[1]]
    t = spark.createDataFrame(tracks, "job int, camera string, track_id string, class_name string, t0 long, t1 long, conf double")
    d = spark.createDataFrame(pairs, "job int, s_camera string, s_track_id string, t_camera string, t_track_id string, score double, state string, association_id string")
    merged = cluster.merged(t, d, "job")
    groups = [[x] for x in tracks]
    states = {}
    for _, sc, st, tc, tt, score, state, aid in sorted(pairs, key=lambda p: (-p[5], p[7])):
        a, b = (next(g for g in groups if any((x[1], x[2]) == e for x in g)) for e in ((sc, st), (tc, tt)))
        if state != "ambiguous" and a is not b:
            if any(x[1] == y[1] and x[4] <= y[5] and y[4] <= x[5] for x in a for y in b):
                state = "ambiguous"
            else:
                groups.remove(b)
                a += b
        states[aid] = state
    assert {r.association_id: r.state for r in merged.where("association_id IS NOT NULL").collect()} == states
    got = {tuple(sorted((s.camera, s.track_id) for s in r.segments)): r for r in cluster.identities(t, d, merged, "job", "j").collect()}
    assert sorted(got) == sorted(tuple(sorted((x[1], x[2]) for x in g)) for g in groups)
    for g in groups:
        names = {(x[1], x[2]) for x in g}
        own = [p for p in pairs if states[p[7]] != "ambiguous" and {(p[1], p[2]), (p[3], p[4])} <= names]
        r = got[tuple(sorted(names))]
        assert list(r.associations) == sorted(p[7] for p in own) and abs(r.confidence - (min(p[5] for p in own) if own else min(x[6] for x in g))) < 1e-9
        assert r.global_id == str(uuid.uuid5(uuid.NAMESPACE_OID, "j:" + "|".join(sorted(f"{c}:{i}" for c, i in names))))


def test_cells_ids_vectors(spark):
    one = spark.range(1)
    h = lambda x, y: cells.hilbert(F.lit(x), F.lit(y), 16)
    assert tuple(one.select(h(100, 100), h(100, 101), h(5000, 5000)).first()) == (10272, 10273, 34242688)
    spot = F.lit(17.3850), F.lit(78.4867)
    assert tuple(one.select(*(cells.cell64(cells.hilbert(*cells.grid(*spot)), k) for k in (12, 14))).first()) == (630663216607275455, 639655640978990846)
    assert one.select(ids.uuid5(ids.OID, F.lit("é:x"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_OID, "é:x"))
    v = spark.createDataFrame([(1, [1.0, 1.0, 1.0, 1.0]), (2, [1.0, -1.0, 1.0, -1.0]), (3, [-1.0] * 4)], "vec_id long, embedding array<float>")
    best = retrieval.nearest_by_signs(v, "vec_id", "embedding", [0.9, 0.8, 0.95, 0.85], 2, 2.0).collect()
    assert best[0].vec_id == 1 and best[0].hamming == 0 and best[0].cosine > 0.98 and len(best) == 2
    assert one.select(vectors.similarity(F.lit(None).cast("array<float>"), F.array(F.lit(1.0)))).first()[0] is None


def test_claims_and_terms(spark):
    one = spark.range(1)
    facts = F.lit("2 events observed Processed 10 observations across 1 track over 3.0 seconds.")
    assert tuple(one.select(retrieval.grounded(F.lit("Processed 11 observations."), facts), retrieval.grounded(F.lit("10 and 3.0"), facts)).first()) == (False, True)
    assert one.select(retrieval.terms(F.lit("Find a moving vehicle é"))).first()[0] == ["find", "moving", "vehicle", "é"]
    assert {"car", "motion"} <= set(retrieval.expanded(["moving", "vehicle"]))
    assert one.select(ids.safe_component(F.lit("../camera/a"))).first()[0] == "___camera_a"
    ranks = spark.createDataFrame([("x", "l", 1), ("x", "l", 2)], "id string, ranking string, rank int")
    assert retrieval.fused(ranks, "id", 3).first().score == 1 / 61
    assert one.select(retrieval.transition("door_openness", F.lit("closed"), F.lit("open"))).first()[0] == "opening"
    assert one.select(retrieval.unfenced(F.lit('```json\n{"a": 1}\n```'))).first()[0] == '{"a": 1}'


def test_masks(spark):
    tracker = sequences.MaskTracker(grace=5)
    face = ([0.4, 0.4, 0.1, 0.1], 0.85)
    assert tracker.frame([face])[0]["box"][2] > 0.10
    for k in range(1, 6):
        assert [m["occlusion_frames"] for m in tracker.frame([])] == [k]
    assert tracker.frame([]) == []


def test_segments(spark):
    rows = pd.DataFrame({"camera": 0, "t": [500 * k for k in range(40)], "activity": [0.9 if k == 10 else 0.0 for k in range(40)], "quality": 0.5, "threshold": 0.18})
    got = [(r.start_ms, r.end_ms, r.boundary_reason) for r in sequences.segmented(spark.createDataFrame(rows), "camera").orderBy("event").collect()]
    assert got == [(0, 5000, "stream_start"), (5000, 19540, "stream_end")]
