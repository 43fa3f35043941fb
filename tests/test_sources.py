"""Sources, sinks and streams on small cases."""

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from tidewright.functions import geometry, vectors
from tidewright.operators import rules, sequences
from tidewright.sources import records
from tidewright.streaming import rules_stream


def run(stream, name, where):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(where)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_observations_and_frames(spark, tmp_path):
    assert records.observations(spark).count() == 11
    (tmp_path / "a.json").write_text('{"track_id": "a", "class_name": "car", "t": 5, "seq": 1, "conf": 0.5, "x": 0, "y": 0, "w": 1, "h": 1}\n')
    assert records.observations(spark, str(tmp_path / "a.json")).first().t == 5
    (tmp_path / "b.json").write_text("{nonsense\n")
    with pytest.raises(Exception):
        records.observations(spark, str(tmp_path / "b.json")).collect()
    lines = spark.createDataFrame([(1, 0, "R {\"n\": 1}"), (1, 1, "noise"), (1, 2, "  R {\"n\": 2}"), (2, 0, "R {\"sessions\": [{\"n\": 3}, {\"n\": 4}]}")], "job int, nth int, value string")
    assert sorted((r.job, r.session, r.n) for r in records.last_framed(lines, "R ", "n int", "job").collect()) == [(1, 0, 2), (2, 0, 3), (2, 1, 4)]
    with pytest.raises(Exception):
        records.last_framed(lines.where("nth = 1"), "R ", "n int", "job").collect()
    assert [r.n for r in records.framed(lines.where("job = 1 AND nth = 0"), "R ", "n int").collect()] == [1]
    with pytest.raises(Exception):
        records.framed(lines.where("nth = 0"), "R ", "n int", most=3).collect()


def test_files_manifests_and_cache(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(b"abc")
    assert records.files(spark, str(tmp_path / "f")).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    with pytest.raises(Exception):
        records.files(spark, str(tmp_path / "f"), 2).collect()
    for k, (version, state, policy) in enumerate([(1, "running", "a"), (1, "completed", "b")]):
        (tmp_path / f"m{k}.json").write_text(json.dumps({"version": version, "state": state, "policy": policy}))
    schema = "version int, state string, policy string"
    assert sorted(r.state for r in records.manifests(spark, f"{tmp_path}/m*.json", schema).collect()) == ["completed", "failed"]
    assert [r.policy for r in records.manifests(spark, f"{tmp_path}/m*.json", schema, policy="b").collect()] == ["b"]
    with pytest.raises(Exception):
        records.manifests(spark, f"{tmp_path}/m*.json", schema, versions=(2,)).collect()
    have, todo = records.cached(spark.range(5).withColumnRenamed("id", "key"), spark.range(3).withColumnRenamed("id", "key"))
    assert have.count() == 3 and todo.count() == 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "s0", "rtsp://u:p@h/1", "x"), (1, "a", "s1", "rtsp://u:p@h/1", "y"), (1, "b", "s0", "http://h", "z")], "job int, camera string, session string, url string, payload string")
    records.discarded(rows)
    assert spark.read.json(records.published(rows, str(tmp_path / "pub"))).count() == 3
    stored = records.checkpointed(rows, str(tmp_path / "cp"))
    assert stored.count() == 2 and "u:p" not in "".join(r.body for r in spark.read.parquet(str(tmp_path / "cp")).collect())
    manifest = stored.select("job", "camera", F.when(F.col("camera") == "b", "other").otherwise(F.col("sha256")).alias("sha256")).union(spark.sql("SELECT 1, 'c', 'x'"))
    assert {r.camera: r.state for r in records.reusable(stored, manifest).collect()} == {"a": "reuse", "b": "changed", "c": "missing"}
    with pytest.raises(Exception):
        records.checkpointed(rows, str(tmp_path / "small"), 10)
    message = records.envelopes(rows, "result", "job").first()
    body = json.loads(message.value)
    assert message.key == "1" and body["kind"] == "result" and re.fullmatch("[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", body["message_id"])
    path = records.backup(rows, str(tmp_path / "bk"), "camera")
    gone = spark.sql("SELECT 'b' AS camera")
    assert records.restored(spark, path, "camera", gone.limit(0), gone).count() == 2
    spark.read.parquet(path).withColumn("payload", F.lit("!")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception):
        records.restored(spark, str(tmp_path / "bad"), "camera", gone, gone).collect()
    records.trajectories(spark.createDataFrame([(1_700_000_000_000, 5, 7, "a")], "t long, cell long, hilbert long, track string"), str(tmp_path / "tr"))
    assert spark.read.parquet(str(tmp_path / "tr")).first().month == 202311


def test_vector_insert(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<double>")
    new = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [1.0, -1.0]), (6, [1.0, 1.0]), (6, [2.0, 1.0]), (7, None)], "vec_id int, embedding array<double>")
    got = {r.vec_id: (r.violation, r.signs) for r in records.insertable(new, store, 2).collect()}
    assert {k: v for k, (v, _) in got.items()} == {1: "duplicate", 2: "zero", 3: "finite", 4: "dimension", 5: None, 6: "duplicate", 7: "dimension"} and got[5][1] == [1]


def test_stream_ends_and_resets(spark, tmp_path):
    obs = records.sample(spark).withColumn("camera", F.lit(0).cast("bigint")).withColumn("control", F.lit(None).cast("string"))
    ends = [(t, None, None, 100 + k, None, None, None, None, None, 0, c) for k, (t, c) in enumerate([("person-001", "end"), ("vehicle-001", "reset")])]
    obs.union(spark.createDataFrame(ends, obs.schema)).repartition(1).write.json(str(tmp_path / "in"))
    got = run(rules_stream.events(spark.readStream.schema(obs.schema).json(str(tmp_path / "in")), rules.SAMPLE_POLICY), "ended", tmp_path / "cp")
    batch = rules.events(obs, rules.SAMPLE_POLICY, ["camera"]).collect()
    key = lambda r: (r.track_id, r.t, r.event_type, r.zone_id or "", r.line_id or "")
    assert sorted(key(r) for r in got if r.event_type != "track_ended") == sorted(key(r) for r in batch if r.event_type != "dwell_threshold_exceeded" or r.track_id == "person-001")
    assert [(r.track_id, r.class_name) for r in got if r.event_type == "track_ended"] == [("person-001", "person")]


def test_stream_refuses_times_that_run_backwards(spark, tmp_path):
    rows = [("a", "car", t, k, 0.5, 0.1, 0.1, 0.1, 0.1, 0) for k, t in enumerate((5, 5, 4))]
    obs = spark.createDataFrame(rows, "track_id string, class_name string, t long, seq long, conf double, x double, y double, w double, h double, camera long")
    obs.repartition(1).write.json(str(tmp_path / "in"))
    with pytest.raises(Exception, match="time runs backwards"):
        run(rules_stream.events(spark.readStream.schema(obs.schema).json(str(tmp_path / "in")), rules.SAMPLE_POLICY), "backwards", tmp_path / "cp")


def test_mask_stream_equals_batch(spark, tmp_path):
    box = lambda x: [(x, 0.2, 0.1, 0.1, 0.9)]
    rows = [("s", k * 100, k, box(0.1 + k / 50) if k % 3 else [], None) for k in range(9)]
    frames = spark.createDataFrame(rows, "scope string, t long, seq long, detections array<struct<x:double,y:double,w:double,h:double,conf:double>>, control string")
    for k in range(3):
        frames.where(f"floor(seq / 3) = {k}").repartition(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    got = run(rules_stream.masks(stream), "masks", tmp_path / "cp")
    batch = sequences.privacy_masks(frames.select("scope", "t", "detections"), "scope").collect()
    plain = lambda rs: sorted((r.t, r.mask_id, round(r.x, 6), round(r.w, 6), r.occlusion_frames) for r in rs)
    assert plain(got) == plain(batch) and len(got) > 5


def test_anomaly_stream_and_hourly_counts(spark, tmp_path):
    rows = [("s", k * 10, k, 0.9 if k != 7 else 0.1, 0.8) for k in range(20)]
    scores = spark.createDataFrame(rows, "scope string, t long, seq long, first double, raw double")
    scores.repartition(1).write.json(str(tmp_path / "in"))
    got = sorted(run(rules_stream.anomalies(spark.readStream.schema(scores.schema).json(str(tmp_path / "in"))), "odd", tmp_path / "cp"), key=lambda r: r.seq)
    assert [r.run for r in got] == [*range(1, 8), 0, *range(1, 13)] and [r.seq for r in got if r.alert] == [4, 5, 6, *range(12, 20)]
    for k, times in enumerate((["2024-01-01 00:10:00", "2024-01-01 00:50:00"], ["2024-01-01 01:30:00"], ["2024-01-01 02:30:00"], ["2024-01-01 00:20:00", "2024-01-01 04:00:00"])):
        (tmp_path / "ev").mkdir(exist_ok=True)
        (tmp_path / "ev" / f"{k}.json").write_text("".join(json.dumps({"time": t, "event_type": "x"}) + "\n" for t in times))
        os.utime(tmp_path / "ev" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    events = spark.readStream.schema("time timestamp, event_type string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "ev"))
    hours = run(rules_stream.hourly(events), "hours", tmp_path / "cp2")
    assert [(r.hour.hour, r.events) for r in sorted(hours, key=lambda r: r.hour)] == [(0, 2), (1, 1), (2, 1)]


def test_boxes_signatures_agreement(spark):
    one = spark.range(1)
    a, b = ({k: F.lit(v) for k, v in zip("xywh", box)} for box in ((0.0, 0.0, 0.2, 0.2), (0.1, 0.0, 0.2, 0.2)))
    assert abs(one.select(geometry.iou(a, b).alias("v")).first().v - 1 / 3) < 1e-9
    arr = lambda *v: F.array(*map(F.lit, v))
    assert [r.v for r in one.select(F.explode(F.array(vectors.signature_distance(arr(1.0, 0.0), arr(0.6, 0.8)), vectors.signature_distance(arr(1.0), arr(0.6, 0.8)))).alias("v")).collect()] == pytest.approx([0.4, 0.5])
    box = "array<struct<class_name:string,x:double,y:double,w:double,h:double,conf:double>>"
    pairs = spark.createDataFrame([("c", [("car", 0.0, 0.0, 0.2, 0.2, 0.9), ("car", 0.5, 0.5, 0.2, 0.2, 0.8)], [("car", 0.01, 0.0, 0.2, 0.2, 0.7), ("dog", 0.5, 0.5, 0.2, 0.2, 0.8)]), ("c", [], [])], f"key string, a {box}, b {box}")
    r = sequences.agreement_summary(pairs, "key").first()
    assert (r.frames, r.left, r.right, r.matched, r.both_empty, r.recall, r.precision) == (2, 2, 2, 1, 1, 0.5, 0.5) and abs(r.mean_conf_delta - 0.2) < 1e-6
