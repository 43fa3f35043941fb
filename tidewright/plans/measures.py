"""Queries of signals, reports, source labels and retrieval metrics, over records derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import retrieval, rules, signals
from ..views import view, with_views
from . import frames


def motion_vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("seq") % 11 == 0, "edge")
    return view(spark, sf_dir, "obs").select("seq", signals.motion_class(F.col("x") * 60, F.col("y") * 60, given).alias("category"))


def motion_entropy_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").select("camera", F.floor(F.col("t") / 3_600_000).alias("frame"), (F.col("x") * 40).alias("mx"), (F.col("y") * 40).alias("my"), "x", "y", "w", "h", (F.col("seq") % 7 == 0).alias("intra"))
    out = signals.gating(rows, ["camera", "frame"])
    return out.withColumn("extent", F.array_join(F.transform("extent", lambda v: F.format_string("%.3f", v)), ","))


def tracker_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").groupBy("camera", F.floor(F.col("t") / 7_200_000).alias("frame")).agg(F.sort_array(F.collect_list(F.struct("x", "y", "w", "h"))).alias("boxes"), F.round(F.avg("x") * 10, 6).alias("shake"), F.round(F.max("conf") * 7, 6).alias("ratio"))
    r = rows.withColumn("r", signals.routing(F.col("boxes"), F.col("shake"), F.col("ratio")))
    return r.select("camera", "frame", "r.tracker", "r.regime", F.coalesce(F.size("r.points"), F.lit(0)).alias("points"), F.round(F.get("r.points", F.lit(0))["y"], 6).alias("first_y"))


def liveness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").withColumn("nth", F.row_number().over(Window.partitionBy("camera").orderBy("seq")) - 1).withColumn("block", F.floor(F.col("nth") / 256))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("nth", c.alias("v")))), lambda x: x["v"])
    per = rows.groupBy("camera", "block").agg(ordered(F.when(F.col("nth") % 256 == 77, F.col("conf") + 9).otherwise(F.col("conf"))).alias("matrix"), F.max("nth").alias("frames"), ordered(49.5 + F.col("x")).alias("trace"), ordered(F.when(F.col("block") % 2 == 0, 49.5 + F.col("x") + F.col("conf") / 50).otherwise(49 + F.col("y") * F.when(F.col("block") % 3 == 0, 9).otherwise(1))).alias("reference"))
    source = F.concat_ws(":", F.col("camera").cast("string"), F.col("block").cast("string"))
    return signals.liveness(per.withColumns({"source": source, "pce": signals.peak_energy(F.col("matrix"), 16, 16)}))


def association_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").withColumn("reconnect", F.col("class_name") == "error")
    return signals.continuity(rows, "camera", 600_000).select("camera", "seq", "epoch", "session_track", "limited")


def capture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.sessions(view(spark, sf_dir, "obs").withColumn("reconnect", F.lit(False)), "camera")


def diverse_track_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").where("class_name IN ('click', 'view')").select("camera", "track_id", (F.col("t") / 1000).cast("bigint").alias("t"), "seq", "x", "y", (0.05 + F.col("conf") * 0.3).alias("w"), (0.1 + F.col("y") / 5).alias("h"))
    return signals.clear_windows(rows, ["camera", "track_id"], (1280, 720)).select("camera", "track_id", "t", F.round("min_edge", 6).alias("min_edge"), F.round("ratio", 6).alias("ratio"), "n")


def trace_exclusive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "memory_events").select(F.col("event_id").alias("span"), F.when(F.col("event_id") > 0, F.floor((F.col("event_id") - 1) / 2)).alias("parent"), "start_ms", "end_ms")
    return signals.exclusive_times(spans)


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("source", F.lit("/"), "lang").alias("query"), F.col("doc_id").alias("item"), "n_chars")
    ranked = d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "item")))
    bad = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(F.col("doc_id").alias("item"))
    return signals.metrics(ranked, d.join(bad, "item"))


def query_decoupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.get(F.array(*map(F.lit, ["How many ", "Why did the SCAR ", "package BEFORE ", "show the crowd ", ""])), (F.col("p_partkey") % 5).cast("int")), "p_name", F.when(F.col("p_partkey") % 3 == 0, " in a van").otherwise(""))
    entities, kind = signals.decoupled(text)
    return rows.select("p_partkey", F.array_join(entities, ",").alias("entities"), kind.alias("query_type"))


def url_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ids.redacted_url(F.col("url")).alias("hidden"), ids.safe_component(F.col("url")).alias("component"), ids.camera_id(F.col("page_id"), F.col("url")).alias("camera_id"))


def rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs")
    return signals.report(obs, rules.summaries(obs, frames.POLICY, ["camera"]), rules.events(obs, frames.POLICY, ["camera"]))


def rule_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.events(view(spark, sf_dir, "obs"), frames.POLICY, ["camera"]).select("camera", "track_id", "t", "seq", "event_type", "description")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = lambda name, *order: d.select("doc_id", F.lit(name).alias("ranking"), F.struct(*order).alias("o")).orderBy("o").limit(200).withColumn("rank", F.row_number().over(Window.orderBy("o"))).drop("o")
    long, short = by("long", (-F.col("n_chars")).alias("n"), "doc_id"), by("first", "doc_id")
    fused = retrieval.fused(long.unionByName(short).unionByName(short.withColumn("rank", F.col("rank") + 7)), "doc_id", 50)
    return fused.select("doc_id", F.round("score", 9).alias("score"))


QUERIES = {f.__name__: f for f in (motion_vector_classes, motion_entropy_gating, tracker_routing, liveness_verdict, association_epochs, capture_sessions, diverse_track_windows, trace_exclusive_time, retrieval_metrics, query_decoupling, url_redaction, rule_report, rule_descriptions, rrf_fusion)}


def _uuid5(namespace: str, name: str) -> str:
    from .stories import uuid5_sql

    return uuid5_sql(namespace, name)


_TEXT = "CASE p_partkey % 5 WHEN 0 THEN 'How many ' WHEN 1 THEN 'Why did the SCAR ' WHEN 2 THEN 'package BEFORE ' WHEN 3 THEN 'show the crowd ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' in a van' ELSE '' END"
_DESCRIBED = frames._BASE + """, x AS (SELECT r.*, class_name || CASE WHEN event_type IN ('restricted_zone_occupied', 'object_entered_zone') THEN ' entered zone ' || zone_id WHEN event_type = 'object_exited_zone' THEN ' exited zone ' || zone_id WHEN event_type = 'line_crossed' THEN ' crossed line ' || line_id || ' in the ' || direction || ' direction'
  ELSE ' remained visible for ' || CAST((SELECT ended_at_ms - started_at_ms FROM s WHERE s.camera = r.camera AND s.track_id = r.track_id) // 1000 AS VARCHAR) || ' seconds' END AS description,
  CASE event_type WHEN 'object_exited_zone' THEN 1 WHEN 'line_crossed' THEN 2 WHEN 'dwell_threshold_exceeded' THEN 3 ELSE 0 END AS phase FROM r)"""
SQL = {
    "motion_vector_classes": with_views("SELECT seq, CASE WHEN seq % 11 = 0 THEN 'edge' WHEN sqrt(x * x + y * y) * 60 <= 2 THEN 'noise' WHEN sqrt(x * x + y * y) * 60 > 50 THEN 'edge' WHEN x * 60 > 15e-1 OR y * 60 > 15e-1 THEN 'foreground' ELSE 'background' END AS category FROM obs", "obs"),
    "motion_entropy_gating": with_views("""WITH v AS (SELECT camera, CAST(floor(t / 3600000e0) AS BIGINT) AS frame, x, y, w, h, sqrt((x * 40) * (x * 40) + (y * 40) * (y * 40)) AS mag, seq % 7 = 0 AS intra, x * 40 > 15e-1 OR y * 40 > 15e-1 AS big FROM obs),
k AS (SELECT *, mag > 2 AND mag <= 50 AND big AS fg FROM v), b AS (SELECT camera, frame, least(floor(mag / 5), 7) AS bin, count(*) AS n FROM k WHERE mag > 2 GROUP BY ALL), t AS (SELECT camera, frame, sum(n) AS total FROM b GROUP BY ALL),
e AS (SELECT b.camera, b.frame, least(1, -sum(n / total * log2(n / total)) / 3) AS entropy FROM b JOIN t ON t.camera = b.camera AND t.frame = b.frame GROUP BY b.camera, b.frame),
f AS (SELECT camera, frame, count(CASE WHEN intra OR fg THEN 1 END) AS foreground, count(CASE WHEN fg THEN 1 END) AS moving, min(CASE WHEN fg THEN x END) AS x0, min(CASE WHEN fg THEN y END) AS y0, max(CASE WHEN fg THEN x + w END) AS x1, max(CASE WHEN fg THEN y + h END) AS y1 FROM k GROUP BY ALL),
g AS (SELECT f.*, least(foreground / 100e0, 1) AS share, coalesce(entropy, 0) AS ent FROM f LEFT JOIN e ON e.camera = f.camera AND e.frame = f.frame)
SELECT camera, frame, foreground, round(share, 6) AS ratio, round(ent, 6) AS entropy, share >= 35e-3 OR (ent >= 25e-2 AND moving > 8) AS decode, round(1200 + 100 * CASE WHEN share > 35e-3 THEN 1 - share ELSE 5e-2 END, 6) AS loss, CASE WHEN moving >= 4 THEN printf('%.3f,%.3f,%.3f,%.3f', CAST(x0 AS DOUBLE), CAST(y0 AS DOUBLE), CAST(x1 AS DOUBLE), CAST(y1 AS DOUBLE)) END AS extent FROM g""", "obs"),
    "tracker_routing": with_views("""SELECT camera, frame, CASE WHEN n >= 25 THEN 'point_localization' WHEN ratio >= 6 THEN 'sr_track' WHEN shake >= 45e-1 THEN 'bot_sort' ELSE 'byte_track' END AS tracker, CASE WHEN n >= 25 THEN 'ultra_dense_handover' WHEN n >= 20 THEN 'dense' ELSE 'sparse_to_moderate' END AS regime,
  CAST(CASE WHEN n >= 25 THEN n ELSE 0 END AS INT) AS points, CASE WHEN n >= 25 THEN round(y0 + 25e-3, 6) END AS first_y
FROM (SELECT camera, CAST(floor(t / 7200000e0) AS BIGINT) AS frame, count(*) AS n, round(max(conf) * 7, 6) AS ratio, round(avg(x) * 10, 6) AS shake, arg_min(y, x * 1000000 + y) AS y0 FROM obs GROUP BY ALL) q""", "obs"),
    "liveness_verdict": with_views("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY seq) - 1 AS nth FROM obs), b AS (SELECT camera, nth // 256 AS block, nth, nth % 256 AS k, CASE WHEN nth % 256 = 77 THEN conf + 9 ELSE conf END AS v, 495e-1 + x AS tr, CASE WHEN (nth // 256) % 2 = 0 THEN 495e-1 + x + conf / 50 ELSE 49 + y * CASE WHEN (nth // 256) % 3 = 0 THEN 9 ELSE 1 END END AS rf FROM r),
p AS (SELECT camera, block, max(v) AS peak, arg_max(k, v * 1000 - k / 1e6) AS pk, count(*) AS n, max(nth) AS frames, bool_and(abs(tr - 50) <= 2 AND abs(rf - 50) <= 2) AS near, coalesce(corr(tr, rf), 0) AS rho FROM b GROUP BY ALL),
e AS (SELECT b.camera, b.block, avg(CASE WHEN abs(k // 16 - pk // 16) > 2 OR abs(k % 16 - pk % 16) > 2 THEN v * v END) AS mean FROM b JOIN p ON p.camera = b.camera AND p.block = b.block GROUP BY ALL),
q AS (SELECT p.*, CASE WHEN n < 256 THEN -1e-1 ELSE peak * peak / mean END AS pce, near AND n >= 4 AS valid FROM p JOIN e ON p.camera = e.camera AND p.block = e.block)
SELECT camera || ':' || block AS source, CASE WHEN frames < 200 THEN 'calibrating' WHEN NOT valid THEN 'invalid_signals' WHEN pce >= 60 AND rho >= 85e-2 THEN 'unverified_signals' WHEN pce < 60 AND rho < 85e-2 THEN 'signals_below_threshold' WHEN pce < 60 THEN 'sensor_signal_mismatch' ELSE 'enf_signal_mismatch' END AS status, CASE WHEN valid AND frames >= 200 THEN round(rho, 6) ELSE 0 END AS rho, false AS is_authentic FROM q""", "obs"),
    "association_epochs": with_views("""WITH g AS (SELECT camera, seq, track_id, CASE WHEN lag(t) OVER w IS NOT NULL AND (t - lag(t) OVER w > 600000 OR class_name = 'error') THEN 1 ELSE 0 END AS cut FROM obs WINDOW w AS (PARTITION BY camera ORDER BY seq)),
e AS (SELECT camera, seq, track_id, CAST(sum(cut) OVER (PARTITION BY camera ORDER BY seq) AS BIGINT) AS epoch FROM g)
SELECT camera, seq, epoch, CASE WHEN epoch > 0 THEN 'session-' || epoch || ':' || track_id ELSE track_id END AS session_track, max(epoch) OVER (PARTITION BY camera) >= 256 AS limited FROM e""", "obs"),
    "capture_sessions": with_views("""WITH g AS (SELECT camera, t, seq, CASE WHEN t - lag(t) OVER (PARTITION BY camera ORDER BY seq) > 1000 THEN 1 ELSE 0 END AS cut FROM obs), e AS (SELECT camera, t, CAST(sum(cut) OVER (PARTITION BY camera ORDER BY seq) AS BIGINT) AS epoch FROM g)
SELECT camera, epoch, min(t) AS first_ms, max(t) AS last_ms, count(*) AS frames, (SELECT max(epoch) FROM e m WHERE m.camera = e.camera) >= 256 AS limited FROM e GROUP BY camera, epoch""", "obs"),
    "diverse_track_windows": with_views("""WITH b AS (SELECT camera, track_id, CAST(trunc(t / 1000e0) AS BIGINT) AS t, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(5e-2 + conf * 3e-1, seq) AS w, arg_max(1e-1 + y / 5, seq) AS h FROM obs WHERE class_name IN ('click', 'view') GROUP BY ALL),
p AS (SELECT *, least(w * 1280, h * 720) AS edge, w * h AS area FROM b WHERE x + w <= 1001e-3 AND y + h <= 1001e-3 AND least(w * 1280, h * 720) >= 48),
j AS (SELECT f.camera, f.track_id, f.t, min(o.edge) AS min_edge, max(o.area) / min(o.area) AS ratio, count(*) AS n, max(o.t) - f.t AS span FROM p f JOIN p o ON o.camera = f.camera AND o.track_id = f.track_id AND o.t >= f.t AND o.t < f.t + 20000 GROUP BY f.camera, f.track_id, f.t)
SELECT camera, track_id, t, round(min_edge, 6) AS min_edge, round(ratio, 6) AS ratio, n FROM (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY min_edge DESC, ratio DESC, n DESC, t) AS rn FROM j WHERE n >= 2 AND span >= 1000 AND ratio >= 125e-2) q WHERE rn = 1""", "obs"),
    "trace_exclusive_time": with_views("SELECT p.event_id AS span, p.end_ms - p.start_ms AS inclusive_ms, p.end_ms - p.start_ms - coalesce((SELECT CAST(sum(c.end_ms - c.start_ms) AS BIGINT) FROM memory_events c WHERE c.event_id IN (2 * p.event_id + 1, 2 * p.event_id + 2)), 0) AS exclusive_ms FROM memory_events p", "memory_events"),
    "retrieval_metrics": """WITH r AS (SELECT source || '/' || lang AS query, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS good, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
g AS (SELECT query, count(*) AS returned, sum(CASE WHEN good THEN 1 ELSE 0 END) AS n, """ + ", ".join(f"sum(CASE WHEN good AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}, sum(CASE WHEN good AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (1, 3, 5)) + " FROM r GROUP BY query) SELECT query, returned, " + ", ".join(f"CASE WHEN n > 0 THEN CAST(h{k} > 0 AS INT) END AS hit_at_{k}, CASE WHEN n > 0 THEN round(h{k} / n, 6) END AS recall_at_{k}, CASE WHEN n > 0 THEN round(d{k} / list_sum(list_transform(range(1, CAST(least({k}, n) AS INT) + 1), lambda i: 1 / log2(i + 1))), 6) END AS ndcg_at_{k}" for k in (1, 3, 5)) + " FROM g WHERE query IS NOT NULL",
    "query_decoupling": f"""SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(q, 'car|vehicle|truck|van') THEN 'vehicle' END, CASE WHEN regexp_matches(q, 'person|pedestrian|crowd') THEN 'pedestrian' END, CASE WHEN regexp_matches(q, 'barrier|box|package') THEN 'barrier' END], lambda e: e IS NOT NULL), ',') AS entities,
  CASE WHEN regexp_matches(q, 'before|after|why|preceded') THEN 'causal_investigation' WHEN regexp_matches(q, 'count|how many|footfall') THEN 'footfall_aggregation' ELSE 'visual_semantic_search' END AS query_type FROM (SELECT p_partkey, lower({_TEXT}) AS q FROM part) t""",
    "url_redaction": f"SELECT page_id, regexp_replace(url, '^(\\w+)://.*', '\\1://***') AS hidden, CASE WHEN url = '' THEN 'camera' ELSE substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 80) END AS component, 'camera-' || page_id || '-' || substr({_uuid5(chr(39) + ids.URL.replace('-', '') + chr(39), 'url')}, 1, 8) AS camera_id FROM pages",
    "rule_report": with_views(_DESCRIBED + f""", n1 AS (SELECT row_number() OVER (ORDER BY t, track_id, camera, phase = 3, seq, phase, zone_id, line_id) AS k, {_uuid5(chr(39) + ids.OID.replace('-', '') + chr(39), f"'{rules.NIL}:' || event_type || ':' || track_id || ':' || t || ':' || coalesce(zone_id, '') || ':' || coalesce(line_id, '')")} AS event_id, description FROM x),
cc AS (SELECT string_agg(m || ' ' || class_name, ', ' ORDER BY class_name) AS classes, sum(m) AS tracks FROM (SELECT c.class_name, count(*) AS m FROM s JOIN c ON c.camera = s.camera AND c.track_id = s.track_id GROUP BY c.class_name) q)
SELECT (SELECT count(*) FROM x) || ' deterministic events observed' AS headline, printf('Processed %d observations across %d confirmed tracks (%s) over %.1f seconds and produced %d events.', (SELECT count(*) FROM obs), CAST(tracks AS BIGINT), classes, (SELECT (max(t) - min(t)) / 1000 FROM obs), (SELECT count(*) FROM x)) AS summary,
  (SELECT string_agg(event_id, ',' ORDER BY k) FROM n1 WHERE k <= 8) AS ids, (SELECT string_agg(description, '; ' ORDER BY k) FROM n1 WHERE k <= 6) AS observations FROM cc""", "obs"),
    "rule_descriptions": with_views(_DESCRIBED + "SELECT camera, track_id, t, seq, event_type, description FROM x", "obs"),
    "rrf_fusion": """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents)
SELECT doc_id, round(sum(1e0 / (60 + rank)), 9) AS score FROM (SELECT * FROM a WHERE rank <= 200 UNION ALL SELECT * FROM b WHERE rank <= 200) u GROUP BY doc_id ORDER BY sum(1e0 / (60 + rank)) DESC, doc_id LIMIT 50""",
}
