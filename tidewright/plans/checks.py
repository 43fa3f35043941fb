"""Queries of the checks of requests and results, over records derived from the driver's tables.

The records' SQL is the same for both engines; the rules are the operators' in Spark and written out in the oracles."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import views
from ..functions import vectors
from ..operators import retrieval
from ..operators import validation as v

#: Flat records, by name.
RECORDS = {
    "jobs": """SELECT c_custkey AS job, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 13 = 0 THEN repeat(c_name, 9) ELSE c_name END AS name, c_acctbal / 100 AS fps, c_custkey % 4000 AS seconds,
  CASE c_custkey % 3 WHEN 0 THEN 'rtsp' WHEN 1 THEN 'http' ELSE 'sample' END AS kind, CASE WHEN c_custkey % 5 = 0 THEN 'ftp://h/x' WHEN c_custkey % 7 = 0 THEN 'http://a b' WHEN c_custkey % 3 = 0 THEN 'rtsps://cam/1' ELSE 'https://cam/1' END AS uri,
  CASE WHEN c_custkey % 17 = 0 THEN '' ELSE 'z' END AS zone_id, c_custkey % 5 + 1 AS n_points, c_acctbal / 9000 AS x, (c_custkey % 10) / 10e0 AS appearance, 4e-1 + (c_custkey % 7) / 10e0 AS provisional, 5e-1 + (c_custkey % 6) / 10e0 AS final, c_custkey % 4 AS tolerance_ms,
  CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN 'too short' ELSE concat('key-', c_name) END AS key, c_custkey % 60 AS lim, concat('what happened ', c_name) AS query, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 10 END AS start_ms, 5000 + c_custkey % 100 AS end_ms FROM customer""",
    "cams": """SELECT o_custkey AS job, concat('cam ', CAST(o_orderkey % 40 AS VARCHAR(20))) AS camera_id, CASE WHEN o_orderkey % 19 = 0 THEN 'file://x' WHEN o_orderkey % 23 = 0 THEN 'http://a b' ELSE concat('http://cam/', CAST(o_orderkey % 500 AS VARCHAR(20))) END AS uri, CAST(floor(o_totalprice * 20) AS BIGINT) - 2000000 AS offset_ms,
  repeat('d', CAST(o_orderkey % 1010 AS INT)) AS description, o_totalprice / 4000 - 95 AS lat, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 2000 - 185 END AS lng FROM orders""",
    "edges": """SELECT o_custkey AS job, concat('e', CAST(o_orderkey % 30 AS VARCHAR(20))) AS edge_id, concat('cam ', CAST(o_orderkey % 40 AS VARCHAR(20))) AS source, concat('cam ', CAST((o_orderkey + o_orderkey % 4) % 40 AS VARCHAR(20))) AS target, o_orderkey % 100 AS low, o_orderkey % 130 + 5 AS high, o_totalprice / 400000 AS confidence FROM orders""",
    "items": """SELECT o_custkey AS query, CASE WHEN o_custkey % 10 = 0 THEN 'other' WHEN o_custkey % 2 = 0 THEN 'hybrid_rrf' ELSE 'hybrid_qwen_reranker' END AS mode, 12 AS lim, o_orderkey % 97 AS event_id, o_totalprice / 450000 AS score, o_orderstatus AS st, o_orderkey FROM orders""",
    "nodes": """SELECT CASE WHEN s_suppkey % 20 = 0 THEN 'same' WHEN s_suppkey % 31 = 0 THEN '' ELSE s_name END AS camera, s_name AS contributor, s_suppkey % 9 AS overlap, s_acctbal / 9500 AS q1, (s_suppkey % 12) / 10e0 AS q2, s_acctbal / 100 AS pce, s_acctbal / 9000 AS rho, 4e-1 + (s_suppkey % 30) / 10e0 AS zoning, s_acctbal * 4 AS uptime, s_suppkey FROM supplier""",
    "sess": """SELECT camera, nth, first_frame, last_frame, first_ms, last_ms, max(last_frame) OVER (PARTITION BY camera) + CASE WHEN camera % 5 = 0 THEN 2 ELSE 1 END AS frames FROM (
  SELECT o_custkey AS camera, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth, 10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END AS first_frame,
    10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + 9 AS last_frame, 5000 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + CASE WHEN o_custkey % 7 = 0 THEN 3 ELSE 0 END AS first_ms,
    5000 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) + CASE WHEN o_orderkey % 37 = 0 THEN 4500 ELSE 3000 END AS last_ms FROM orders) q""",
    "parts": """SELECT l_orderkey AS job, l_linenumber % 2 AS camera, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE concat('st-', CAST(l_partkey % 50 AS VARCHAR(20))) END AS storage, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE concat('s', CAST(l_partkey % 20 AS VARCHAR(20))) END AS session,
  l_suppkey % 40 AS event_id, CASE WHEN l_partkey % 211 = 0 THEN -1 ELSE l_orderkey END AS event_job, CASE WHEN l_partkey % 223 = 0 THEN 9 ELSE l_linenumber % 2 END AS event_camera FROM lineitem""",
    "claims": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_observed' WHEN 2 THEN 'uncertain' ELSE CASE WHEN event_id % 8 = 3 THEN 'supported' ELSE 'maybe' END END AS status, CASE WHEN event_id % 41 = 0 THEN ' ' ELSE 'seen' END AS answer, 0 AS lo, 1000 AS hi,
  event_id % 300 AS t0, 400 + event_id % 700 AS t1, event_id % 2 AS i0, CASE WHEN event_id % 6 = 0 THEN event_id % 2 ELSE 1 - event_id % 2 END AS i1, CASE WHEN event_id % 3 = 0 THEN 'absent' ELSE 'visible' END AS v0, CASE WHEN event_id % 9 = 0 THEN 'unclear' WHEN event_id % 3 = 0 THEN 'absent' ELSE 'visible' END AS v1,
  event_id % 5 AS p0, event_id % 7 AS p1, event_id % 10 <> 0 AS gate_passed, (event_id % 1000) / 2000e0 AS x0, (event_id % 1000) / 2000e0 + CASE WHEN event_id % 3 = 0 THEN 1e-3 ELSE 1e-2 END AS x1, event_id % 4 < 2 AS same_pixels, event_id % 12 = 5 AS lost, value AS mean_difference FROM events""",
    "review": """SELECT doc_id AS cas, CASE quality WHEN 1 THEN 'same' ELSE 'different' END AS identity, toxic = 0 AS reference_visible, doc_id % 4 AS n_visible, doc_id % 3 AS cited_visible, CASE doc_id % 5 WHEN 0 THEN 'uncertain' WHEN 1 THEN 'not_observed' ELSE 'supported' END AS status, CASE WHEN doc_id % 2 = 0 THEN 'approaching' ELSE 'receding' END AS claimed,
  CASE doc_id % 7 WHEN 0 THEN 'unclear' WHEN 1 THEN 'far' WHEN 2 THEN 'middle' ELSE 'near' END AS s0, CASE doc_id % 11 WHEN 0 THEN 'unclear' WHEN 1 THEN 'near' WHEN 2 THEN 'middle' ELSE 'far' END AS s1, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'ann' END AS reviewer, doc_id % 6 AS n_frames, doc_id % 8 AS reviewed FROM labels""",
    "reads": """SELECT o_orderkey AS request, concat(CASE WHEN o_orderkey % 9 = 0 THEN '/other/' WHEN o_orderkey % 14 = 0 THEN '/data/../' ELSE '/data/' END, CAST(o_custkey % 70 AS VARCHAR(20))) AS path, o_orderkey % 50 AS start_ms, o_orderkey % 60 AS end_ms, CAST(o_orderkey % 5 AS VARCHAR(20)) AS sha FROM orders""",
}


def record(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = RECORDS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in views.TABLES if re.search(rf"FROM {t}\b", text)}
    return spark.sql(re.sub(rf"FROM ({'|'.join(used)})\b", r"FROM {\1}", text), **used)


def _sql(body: str, *names: str) -> str:
    heads = ", ".join(f"{n} AS ({RECORDS[n]})" for n in names)
    return f"WITH {heads}" + (f", {body.lstrip()[4:]}" if body.lstrip().startswith("WITH") else f" {body}")


def _codes(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules.items()) + "], lambda r: r IS NOT NULL), ',')"


def validate_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "jobs")
    point = lambda k: F.array(F.col("x"), F.lit(k) / 5)
    points = F.slice(F.array(*[point(k) for k in range(5)]), 1, F.col("n_points").cast("int"))
    rows = rows.withColumn("zones", F.array(F.struct(F.col("zone_id").alias("id"), points.alias("points"))))
    return rows.select("job", v.job_request().alias("violations"), v.points_inside(points).alias("inside"))


def validate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.cluster_requests(*(record(spark, sf_dir, n) for n in ("jobs", "cams", "edges")))


def validate_memory_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.memory_requests(record(spark, sf_dir, "jobs"), record(spark, sf_dir, "cams").withColumnRenamed("uri", "url"))


def validate_memory_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "jobs").withColumn("limit", F.col("lim")).withColumn("sessions", F.array("key", F.lit("s")))
    return rows.select("job", v.memory_query().alias("violations"), v.short_list(F.array("name", "uri"), 2, 100).alias("listed"), v.scope("kind", "zone_id", "key").alias("scoped"))


def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = record(spark, sf_dir, "items").withColumnRenamed("lim", "limit")
    return v.search_results(items, items.where("st <> 'P'"))


def validate_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "items").withColumnRenamed("query", "case").withColumnRenamed("st", "profile")
    return v.experiment_results(rows, rows.where("event_id < 90"), "F")


def validate_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.reward_nodes(record(spark, sf_dir, "nodes").withColumn("quality", F.array("q1", "q2"))).select("s_suppkey", "violations")


def validate_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.capture_sessions(record(spark, sf_dir, "sess"))


def validate_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "parts")
    return v.checkpoints(rows, rows)


def validate_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cite = lambda k: F.struct(F.col(f"i{k}").cast("bigint").alias("index"), F.when(F.col(f"i{k}") == 0, F.col("t0")).otherwise(F.col("t1")).alias("t"), F.col(f"v{k}").alias("visibility"))
    rows = record(spark, sf_dir, "claims").withColumns({"times": F.array("t0", "t1"), "citations": F.array(cite(0), cite(1)), "images": F.array(F.col("p0").cast("string"), F.col("p1").cast("string"))})
    return rows.select("event_id", v.interpretation().alias("violations"))


def track_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    crop = lambda k: F.struct(F.col(f"t{k}").alias("t"), F.col(f"x{k}").alias("x"), F.lit(0.1).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    rows = record(spark, sf_dir, "claims").withColumn("crops", F.when(F.col("event_id") % 6 != 1, F.array(crop(0), F.when(~F.col("lost"), crop(1)))))
    return rows.select("event_id", v.track_citations().alias("tracked"), v.static_citations().alias("moving"))


def face_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.struct("x", "y", F.col("conf").alias("w"), "h", "conf")
    return v.face_frames(views.view(spark, sf_dir, "obs").select(F.col("camera").alias("scope"), "t", "seq", F.array(box).alias("boxes")))


def review_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "review").withColumnRenamed("cas", "case")
    reviews = rows.where("n_visible > 0").select("case", "reviewer", "identity", "reference_visible", F.col("s0").alias("object"), F.col("reviewed").alias("n_frames"), F.col("s1").alias("sha"), F.array("s0", F.when(F.col("case") % 9 == 0, "huge").otherwise(F.col("s1"))).alias("states"))
    return v.review_packets(rows.select("case", "n_frames", F.lit("far").alias("sha")), reviews)


def review_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    category, passed = v.reviewed_score(retrieval.transition("camera_distance", F.col("s0"), F.col("s1")))
    return record(spark, sf_dir, "review").select(F.col("cas").alias("case"), category.alias("category"), passed.alias("passed"))


def source_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = record(spark, sf_dir, "reads")
    manifest = spark.range(60).select(F.concat(F.lit("/data/"), F.col("id").cast("string")).alias("path"), (F.col("id") % 5).cast("string").alias("sha"))
    revoked = spark.range(5).select(F.concat(F.lit("/data/"), (F.col("id") * 7).cast("string")).alias("path"))
    return v.sources(rows, manifest, revoked, "/data")


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("scaled", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(2.0)))
    unit = vectors.normalized(F.col("scaled"))
    other = F.array_repeat(F.lit(0.125), 64)
    return rows.select("vec_id", unit.isNotNull().alias("normalizable"), vectors.is_unit(unit).alias("unit"), vectors.is_unit(F.col("scaled")).alias("was_unit"), F.round(vectors.dot(unit, other), 6).alias("dot"), F.round(vectors.signature_distance(unit, other), 6).alias("distance"))


QUERIES = {f.__name__: f for f in (validate_jobs, validate_clusters, validate_memory_jobs, validate_memory_queries, validate_results, validate_experiments, validate_rewards, validate_sessions, validate_checkpoints, validate_interpretations, track_guards, face_bounds, review_check, review_score, source_scope, unit_vectors)}

_NAME = "trim(name) = '' OR strlen(name) > 120"
_DISTANCE = "CASE WHEN s0 = 'unclear' OR s1 = 'unclear' OR s0 = s1 THEN NULL WHEN list_position(['far', 'middle', 'near'], s1) > list_position(['far', 'middle', 'near'], s0) THEN 'approaching' ELSE 'receding' END"
_CASES = [("identity <> 'same'", "mixed_or_unclear_identity_history", "status = 'uncertain'"), ("NOT reference_visible", "reference_unresolved", "status = 'uncertain'"), ("n_visible < 2", "insufficient_reviewed_target_visibility", "status = 'uncertain'"), ("status <> 'supported'", "abstained_without_action_comparison", "NULL"), ("cited_visible <> 2", "unsupported_visibility", "false"), ("true", "cited_target_states", f"coalesce({_DISTANCE} = claimed, false)")]

SQL = {
    "validate_jobs": _sql("SELECT job, " + _codes({"name": _NAME, "fps": "fps < 1e-1 OR fps > 60", "duration": "seconds < 1 OR seconds > 3600", "scheme": "(kind = 'rtsp' AND NOT regexp_matches(uri, '^rtsps?://')) OR (kind = 'http' AND NOT regexp_matches(uri, '^https?://'))", "spaces": "kind <> 'sample' AND uri LIKE '% %'", "zone": "zone_id = '' OR n_points < 3", "geometry": "x < 0 OR x > 1"}) + " AS violations, x BETWEEN 0 AND 1 AS inside FROM jobs", "jobs"),
    "validate_clusters": _sql("""WITH c AS (SELECT job, count(*) AS n, count(DISTINCT camera_id) AS ids, bool_or(NOT regexp_matches(uri, '^https?://') OR uri LIKE '% %') AS bad, bool_or(abs(offset_ms) > 3600000) AS clock FROM cams GROUP BY job),
e AS (SELECT job, count(*) AS n, count(DISTINCT edge_id) AS ids, bool_or(source = target) AS self, bool_or(high < low) AS win, bool_or(confidence > 1) AS conf, bool_or(NOT EXISTS (SELECT 1 FROM cams WHERE cams.job = edges.job AND cams.camera_id = source) OR NOT EXISTS (SELECT 1 FROM cams WHERE cams.job = edges.job AND cams.camera_id = target)) AS lost FROM edges GROUP BY job)
SELECT jobs.job, """ + _codes({"name": _NAME, "cameras": "coalesce(c.n, 0) < 2 OR c.n > 64", "camera_twice": "c.ids < c.n", "camera_uri": "c.bad", "clock_offset": "clock", "edge_id": "e.ids < e.n", "edge_loop": "e.self", "edge_camera": "lost", "edge_window": "win", "edge_confidence": "conf", "thresholds": "appearance > 1 OR provisional < 55e-2 OR provisional > 1 OR final < provisional OR final > 1 OR tolerance_ms = 0"}) + " AS violations FROM jobs LEFT JOIN c ON c.job = jobs.job LEFT JOIN e ON e.job = jobs.job", "jobs", "cams", "edges"),
    "validate_memory_jobs": _sql("""WITH c AS (SELECT job, count(*) AS n, count(DISTINCT camera_id) AS ids, count(DISTINCT replace(camera_id, ' ', '_')) AS dirs, count(DISTINCT uri) AS urls, bool_or(NOT regexp_matches(uri, '^(https?|rtsps?)://') OR uri LIKE '% %') AS bad, bool_or(length(description) > 1000) AS long, bool_or(abs(lat) > 90 OR abs(coalesce(lng, 0)) > 180) AS place FROM cams GROUP BY job)
SELECT jobs.job, """ + _codes({"idempotency_key": "NOT regexp_full_match(key, '[A-Za-z0-9_-]{16,128}')", "folder": "dirs < n", "name": _NAME, "cameras": "coalesce(n, 0) < 1 OR n > 64", "fps": "fps < 1e-1 OR fps > 5", "camera_id": "ids < n", "url": "bad", "url_twice": "urls < n", "fields": "long", "coordinates": "place"}) + " AS violations FROM jobs LEFT JOIN c ON c.job = jobs.job", "jobs", "cams"),
    "validate_memory_queries": _sql("SELECT job, " + _codes({"query": "trim(query) = '' OR strlen(query) > 1000", "limit": "lim < 1 OR lim > 50", "times": "end_ms < start_ms"}) + " AS violations, trim(name) <> '' AND strlen(name) <= 100 AS listed, zone_id <> '' AND coalesce(regexp_full_match(key, '[A-Za-z0-9_-]{1,128}'), false) AS scoped FROM jobs", "jobs"),
    "validate_results": _sql("""WITH g AS (SELECT query, min(mode) AS mode, count(*) AS n, count(DISTINCT event_id) AS ids, bool_or(score > 1) AS high, bool_or(NOT EXISTS (SELECT 1 FROM items a WHERE a.query = items.query AND a.event_id = items.event_id AND a.st <> 'P')) AS strange FROM items GROUP BY query)
SELECT query, """ + _codes({"mode": "mode = 'other'", "count": "n > 12", "twice": "ids < n", "not_allowed": "strange", "score": "high"}) + " AS violations FROM g", "items"),
    "validate_experiments": _sql("SELECT query AS \"case\", " + _codes({"profile": "bool_or(st <> 'F')", "twice": "count(DISTINCT event_id) < count(*)", "not_in_scope": "bool_or(event_id >= 90)"}) + " AS violations FROM items GROUP BY query", "items"),
    "validate_rewards": _sql("SELECT s_suppkey, " + _codes({"identity": "camera = ''", "camera_twice": "(SELECT count(*) FROM nodes m WHERE m.camera = nodes.camera) > 1", "overlap": "overlap = 0", "quality": "q1 < 0 OR q1 > 1 OR q2 > 1", "measurement": "rho < -1 OR rho > 1 OR zoning < 5e-1 OR zoning > 3 OR uptime < 0 OR uptime > 36500"}) + " AS violations FROM nodes", "nodes"),
    "validate_sessions": _sql("""WITH p AS (SELECT s.*, b.last_frame AS bf, b.last_ms AS bm, s.nth = (SELECT max(nth) FROM sess z WHERE z.camera = s.camera) AS final FROM sess s LEFT JOIN sess b ON b.camera = s.camera AND b.nth = s.nth - 1)
SELECT camera, """ + _codes({"number": "count(*) > 256", "hole": "bool_or(first_frame <> coalesce(bf + 1, 0))", "order": "bool_or(last_frame < first_frame OR last_ms < first_ms)", "spacing": "bool_or(first_ms - bm <= 1000)", "origin": "bool_or(bm IS NULL AND first_ms <> 0)", "coverage": "bool_or(final AND last_frame + 1 <> frames)"}) + " AS violations FROM p GROUP BY camera", "sess"),
    "validate_checkpoints": _sql("SELECT job, camera, " + _codes({"number": "count(*) > 256", "session_twice": "count(DISTINCT coalesce(session, '')) < count(*)", "storage": "count(DISTINCT storage) < count(storage) OR (count(*) > 1 AND count(storage) < count(*))", "event_twice": "count(DISTINCT event_id) < count(*)", "event_scope": "bool_or(event_job <> job OR event_camera <> camera)"}) + " AS violations FROM parts GROUP BY job, camera", "parts"),
    "validate_interpretations": _sql("SELECT event_id, " + _codes({"status": "status = 'maybe'", "answer": "answer = ' '", "times": "t0 >= t1 OR t1 >= 1000", "citation": "i0 = i1", "two_visible": "status = 'supported' AND (v0 <> 'visible' OR v1 <> 'visible')", "gate": "status = 'supported' AND NOT gate_passed", "repeated_image": "status = 'supported' AND (i0 = i1 OR p0 = p1)", "absence": "status = 'not_observed' AND NOT (i0 <> i1 AND v0 = 'absent' AND v1 = 'absent')"}) + " AS violations FROM claims", "claims"),
    "track_guards": _sql("SELECT event_id, CASE WHEN event_id % 6 <> 1 AND (status = 'not_observed' OR (status = 'supported' AND (lost OR t0 = t1 OR (event_id % 3 = 0 AND same_pixels)))) THEN 'uncertain' ELSE status END AS tracked, CASE WHEN status = 'supported' AND mean_difference <= 5e-1 THEN 'uncertain' ELSE status END AS moving FROM claims", "claims"),
    "face_bounds": views.with_views("SELECT scope, t, seq, " + _codes({"box": "conf = 0 OR x + conf > 1 OR y + h > 1", "time": "t <= earlier"}) + " AS violations FROM (SELECT camera AS scope, t, seq, x, y, h, conf, lag(t) OVER (PARTITION BY camera ORDER BY seq) AS earlier FROM obs) q", "obs"),
    "review_check": _sql("SELECT cas AS \"case\", CASE WHEN n_visible = 0 THEN 'missing' ELSE " + _codes({"reviewer": "reviewer = ''", "frames": "reviewed <> n_frames", "hash": "s1 <> 'far'", "state": "cas % 9 = 0"}) + " END AS violations FROM review", "review"),
    "review_score": _sql("SELECT cas AS \"case\", CASE " + " ".join(f"WHEN {w} THEN '{n}'" for w, n, _ in _CASES) + " END AS category, CASE " + " ".join(f"WHEN {w} THEN {p}" for w, _, p in _CASES) + " END AS passed FROM review", "review"),
    "source_scope": _sql("WITH k AS (SELECT *, CASE WHEN path LIKE '/data/%' AND path NOT LIKE '%..%' THEN CAST(substr(path, 7) AS INT) END AS n FROM reads) SELECT request, " + _codes({"root": "n IS NULL", "revoked": "n % 7 = 0 AND n <= 28", "interval": "start_ms >= end_ms", "missing": "n IS NULL OR n >= 60", "hash": "n < 60 AND CAST(n % 5 AS VARCHAR) <> sha"}) + " AS violations FROM k", "reads"),
    "unit_vectors": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) END AS u, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS n2 FROM embeddings)
SELECT vec_id, u IS NOT NULL AS normalizable, u IS NOT NULL AS unit, vec_id % 7 <> 0 AND abs(2 * sqrt(n2) - 1) <= 1e-6 AS was_unit, round(list_sum(u) * 125e-3, 6) AS dot, CASE WHEN u IS NULL THEN 5e-1 ELSE round(greatest(0, least(1, 1 - list_sum(u) * 125e-3)), 6) END AS distance FROM e""",
}
