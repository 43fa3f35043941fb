"""Queries whose plan is one declarative SQL text, for Spark and the DuckDB oracle alike.

Each entry names the views it reads, then the text. Doubles are rounded to 6 places, as sums differ in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import views

#: name: (views, SQL)
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    # Tracks: votes, summaries, dwell, samples, epochs
    "rule_class_consensus": (("obs",), """
WITH votes AS (SELECT camera, track_id, class_name, round(sum(conf), 9) AS weight FROM obs GROUP BY camera, track_id, class_name),
ranked AS (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY weight DESC, class_name) AS rn, count(*) OVER (PARTITION BY camera, track_id) AS classes FROM votes)
SELECT camera, track_id, class_name, round(weight, 6) AS weight, classes FROM ranked WHERE rn = 1"""),
    "rule_unstable_classes": (("obs",), "SELECT camera, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS unstable_tracks, count(*) AS tracks FROM (SELECT camera, track_id, count(DISTINCT class_name) AS n FROM obs GROUP BY camera, track_id) q GROUP BY camera"),
    "report_class_histogram": (("obs",), "SELECT camera, class_name, count(*) AS observations, count(DISTINCT track_id) AS tracks, max(t) - min(t) AS span_ms, round(max(conf), 6) AS maximum_confidence FROM obs GROUP BY camera, class_name"),
    "distinct_classes": (("obs",), "SELECT DISTINCT class_name FROM obs"),
    "timestamp_sampler": (("obs",), """
SELECT camera, seq, t FROM (SELECT camera, seq, t, row_number() OVER (PARTITION BY camera, CAST(floor((t / 1000.0e0 + 1e-3) / 3600e0) AS BIGINT) ORDER BY t, seq) AS rn FROM obs) q WHERE rn = 1"""),
    # Footfall
    "olap_footfall": (("trajectories",), """
SELECT count(*) AS footfall, count(DISTINCT track_id) AS tracks, coalesce(round(avg(dwell), 6), 0) AS mean_dwell_ms, coalesce(CAST(percentile_disc(5e-1) WITHIN GROUP (ORDER BY dwell DESC) AS BIGINT), 0) AS median_dwell_ms, coalesce(round(avg(velocity), 6), 0) AS mean_velocity
FROM trajectories WHERE t BETWEEN 0 AND 1500000000 AND dwell >= 5000"""),
    "olap_footfall_by_class": (("trajectories",), """
SELECT class_name, count(*) AS footfall, count(DISTINCT track_id) AS tracks, round(avg(dwell), 6) AS mean_dwell_ms, CAST(percentile_disc(5e-1) WITHIN GROUP (ORDER BY dwell DESC) AS BIGINT) AS median_dwell_ms, round(avg(velocity), 6) AS mean_velocity
FROM trajectories WHERE t BETWEEN 0 AND 1500000000 GROUP BY class_name"""),
    # Intervals and evidence
    "interval_union": (("memory_events",), """
WITH m AS (SELECT camera, start_ms, end_ms, max(end_ms) OVER (PARTITION BY camera ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM memory_events),
i AS (SELECT camera, start_ms, end_ms, CAST(sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m),
u AS (SELECT camera, island, max(end_ms) - min(start_ms) AS span FROM i GROUP BY camera, island)
SELECT camera, CAST(sum(span) AS BIGINT) AS union_ms, count(*) AS islands FROM u GROUP BY camera"""),
    "point_in_interval": (("obs", "memory_events"), """
WITH s AS (SELECT event_id, camera, start_ms, end_ms, {buckets} AS bucket FROM memory_events WHERE start_ms < end_ms),
o AS (SELECT seq, camera, t, CAST(floor(t / 16000e0) AS BIGINT) AS bucket FROM obs),
j AS (SELECT o.seq, o.camera, s.event_id, row_number() OVER (PARTITION BY o.seq ORDER BY s.start_ms, s.event_id) AS rn FROM o JOIN s ON o.camera = s.camera AND o.bucket = s.bucket AND o.t >= s.start_ms AND o.t < s.end_ms)
SELECT seq, camera, event_id FROM j WHERE rn = 1"""),
    "evidence_anchors": (("obs", "memory_events"), """
WITH s AS (SELECT event_id, camera, start_ms, end_ms, {buckets} AS bucket FROM memory_events WHERE start_ms < end_ms),
o AS (SELECT seq, camera, track_id, t, CAST(floor(t / 16000e0) AS BIGINT) AS bucket FROM obs),
j AS (SELECT o.track_id, s.event_id, o.seq, row_number() OVER (PARTITION BY o.track_id, s.event_id ORDER BY o.t, o.seq) AS a, row_number() OVER (PARTITION BY o.track_id, s.event_id ORDER BY o.t DESC, o.seq DESC) AS z
  FROM o JOIN s ON o.camera = s.camera AND o.bucket = s.bucket AND o.t >= s.start_ms AND o.t < s.end_ms)
SELECT track_id, event_id, max(CASE WHEN a = 1 THEN seq END) AS first_seq, max(CASE WHEN z = 1 THEN seq END) AS last_seq FROM j GROUP BY track_id, event_id"""),
    "entity_links": (("obs",), """
SELECT camera, track_id, seq AS from_seq, next_seq AS to_seq, gap_ms FROM (SELECT camera, track_id, seq, lead(seq) OVER (PARTITION BY camera, track_id ORDER BY t, seq) AS next_seq, lead(t) OVER (PARTITION BY camera, track_id ORDER BY t, seq) - t AS gap_ms FROM obs) q WHERE next_seq IS NOT NULL"""),
    "entity_first_last": (("obs",), "SELECT camera, track_id, min(t) AS first_ms, max(t) AS last_ms, count(DISTINCT t) > 1 AS has_history FROM obs GROUP BY camera, track_id"),
    "entity_cap": (("obs",), "SELECT camera, track_id, first_ms, rn FROM (SELECT camera, track_id, first_ms, row_number() OVER (PARTITION BY camera ORDER BY first_ms, track_id) AS rn FROM (SELECT camera, track_id, min(t) AS first_ms FROM obs GROUP BY camera, track_id) a) q WHERE rn <= 12"),
    "eligibility_filter": (("memory_events",), "SELECT event_id, camera, start_ms, end_ms FROM memory_events WHERE job = 1 AND camera IN (0, 2) AND end_ms >= 500000000 AND start_ms <= 1500000000"),
    "memory_job_totals": (("memory_events",), "SELECT job, count(DISTINCT camera) AS cameras, count(*) AS events, max(end_ms) AS duration_ms, CAST(sum(event_id % 500) AS BIGINT) AS frames FROM memory_events GROUP BY job"),
    "missing_graph_cameras": (("memory_events", "obs"), "SELECT count(*) AS missing FROM (SELECT DISTINCT camera FROM memory_events) m WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.camera = m.camera AND o.camera < 3)"),
    # Anomalies, gating, routing, liveness
    "anomaly_smoothing_alerts": (("obs",), """
WITH f AS (SELECT camera, seq, t, CASE WHEN 5e-1 * x + 5e-1 * y >= 3e-1 THEN 1 ELSE 0 END AS pass, conf AS raw FROM obs),
s AS (SELECT *, avg(CASE WHEN pass = 1 THEN raw ELSE 0e0 END) OVER (PARTITION BY camera ORDER BY t, seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS smoothed, sum(CASE WHEN pass = 1 AND raw >= 5e-1 THEN 0 ELSE 1 END) OVER (PARTITION BY camera ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS grp FROM f),
r AS (SELECT *, CASE WHEN pass = 1 AND raw >= 5e-1 THEN CAST(sum(CASE WHEN pass = 1 AND raw >= 5e-1 THEN 1 ELSE 0 END) OVER (PARTITION BY camera, grp ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) ELSE 0 END AS run FROM s)
SELECT camera, seq, CASE WHEN pass = 1 THEN round(smoothed, 6) ELSE 0e0 END AS smoothed, run, run >= 5 AND round(smoothed, 9) >= 5e-1 AS alert FROM r"""),
    "enf_correlation": (("obs",), "SELECT camera, CASE WHEN count(*) < 4 THEN 0e0 ELSE round(greatest(-1, least(1, coalesce(corr(x, y), 0))), 6) END AS rho FROM obs GROUP BY camera"),
    "pce": (("obs",), """
WITH c AS (SELECT camera, seq, row_number() OVER (PARTITION BY camera ORDER BY seq) - 1 AS nth, conf AS v FROM obs), m AS (SELECT camera, CAST(floor(nth / 256e0) AS BIGINT) AS matrix, v, nth % 256 AS k, CAST(floor((nth % 256) / 16e0) AS BIGINT) AS py, nth % 16 AS px FROM c),
top AS (SELECT camera, matrix, max(v) AS peak, count(*) AS cells FROM m GROUP BY camera, matrix), f AS (SELECT m.camera, m.matrix, peak, cells, min(k) AS first FROM m JOIN top ON m.camera = top.camera AND m.matrix = top.matrix AND m.v = top.peak GROUP BY m.camera, m.matrix, peak, cells),
p AS (SELECT camera, matrix, peak, cells, first % 16 AS qx, CAST(floor(first / 16e0) AS BIGINT) AS qy FROM f),
e AS (SELECT m.camera, m.matrix, max(peak) AS peak, max(cells) AS cells, sum(CASE WHEN abs(py - qy) > 2 OR abs(px - qx) > 2 THEN v * v END) AS outside, avg(CASE WHEN abs(py - qy) > 2 OR abs(px - qx) > 2 THEN v * v END) AS mean FROM m JOIN p ON m.camera = p.camera AND m.matrix = p.matrix GROUP BY m.camera, m.matrix)
SELECT camera, matrix, CASE WHEN cells < 256 OR coalesce(outside, 0) <= 1e-9 THEN -1e-1 ELSE round(peak * peak / mean, 6) END AS pce FROM e"""),
    "contribution_epoch": ((), """
WITH f AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 <> 0 THEN 1e0 ELSE 0e0 END AS l, least(greatest(((s_suppkey % 10) / 10e0) * 4e-1 + 35e-2 * 9e-1 + 25e-2 * 95e-2, 0), 1) AS q,
    least(greatest((((s_suppkey % 5) / 5e0) * 6e-1 + 5e-1 * 4e-1) * 2 / sqrt(1 + s_nationkey % 4), 1e-1), 2) AS h, least(greatest(1 + least((s_suppkey % 50) * 5e-2, 2), 5e-1), 5) AS d, 1 + 5e-1 * (1 - exp(-1e-2 * greatest(s_suppkey % 365, 0))) AS m FROM supplier),
w AS (SELECT *, CASE WHEN q >= 7e-1 THEN l * q * h * d * m ELSE 0 END AS weight FROM f), t AS (SELECT sum(weight) AS total, CAST(sum(CASE WHEN l > 0 AND q >= 7e-1 THEN 1 ELSE 0 END) AS BIGINT) AS verified_nodes, CAST(sum(CASE WHEN l > 0 AND q >= 7e-1 THEN 0 ELSE 1 END) AS BIGINT) AS disqualified_nodes FROM w)
SELECT verified_nodes, disqualified_nodes, CASE WHEN l = 0 THEN 'disqualified_liveness' WHEN q < 7e-1 THEN 'disqualified_quality' ELSE 'verified' END AS status, node, round(weight, 6) AS weight, round(CASE WHEN l > 0 AND q >= 7e-1 AND total > 0 THEN weight / total ELSE 0 END, 9) AS share, round(CASE WHEN l > 0 AND q >= 7e-1 AND total > 0 THEN 10000 * weight / total ELSE 0 END, 6) AS payout, l > 0 AND q >= 7e-1 AS verified FROM w, t"""),
    "vector_sizing": ((), """
SELECT bits, CAST(floor(1.1e0 * (bits / 8e0 * 384 + 8 * 16) * 100000000) AS BIGINT) AS bytes FROM (SELECT 32 AS bits UNION ALL SELECT 16 UNION ALL SELECT 8 UNION ALL SELECT 1) q"""),
    # Cluster, control, evaluation
    "newest_jobs": ((), "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q WHERE rn <= 3"),
    "corpus_inventory": ((), "SELECT lang, source, count(*) AS clips, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang, source"),
    "split_leakage": ((), "SELECT md5(text) AS digest, count(DISTINCT source) AS splits FROM documents WHERE text IS NOT NULL GROUP BY md5(text) HAVING count(DISTINCT source) > 1"),
    "graph_edges": ((), """
SELECT conv_id * 100 + turn AS source, conv_id * 100 + turn + 1 AS target, 'temporal' AS kind FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) q WHERE nxt = turn + 1
UNION ALL SELECT a.vec_id, b.vec_id, 'bridge' FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10
UNION ALL SELECT b.vec_id, a.vec_id, 'bridge' FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10"""),
    "percentiles": ((), "SELECT lang, round({pct}(n_chars, 5e-1), 6) AS p50, round({pct}(n_chars, 95e-2), 6) AS p95 FROM documents GROUP BY lang"),
}

#: What differs in the few texts that can't be the same.
_FROM, _TO = "CAST(floor(start_ms / 16000e0) AS BIGINT)", "CAST(floor((end_ms - 1) / 16000e0) AS BIGINT)"
DIALECT = {
    "spark": {"{g}": "", "{pct}": "percentile", "{buckets}": f"explode(sequence({_FROM}, {_TO}))"},
    "duck": {"{g}": ", 'g'", "{pct}": "quantile_cont", "{buckets}": f"unnest(range({_FROM}, {_TO} + 1))"},
}


def _text(name: str, engine: str) -> str:
    text = SHARED[name][1]
    for mark, value in DIALECT[engine].items():
        text = text.replace(mark, value)
    return text


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query over its tables and views, which are passed as frames: views of the caller's session stay as they are."""
    body, needed = _text(name, "spark").strip(), SHARED[name][0]
    frames = {v: views.view(spark, sf_dir, v) for v in needed}
    frames |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in views.TABLES if t not in frames and re.search(rf"\b(FROM|JOIN) {t}\b", body)}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", lambda m: f"{m[1]} {{{m[2]}}}" + ("" if re.match(r"\s+(AS\s+)?(?!(WHERE|GROUP|JOIN|ON|LEFT|ORDER|UNION|LIMIT|HAVING)\b)[a-z]\w*", body[m.end():]) else f" AS {m[2]}"), body) if frames else body
    return spark.sql(text, **frames)


QUERIES = {name: (lambda spark, sf_dir, name=name: run(name, spark, sf_dir)) for name in SHARED}
SQL = {name: views.with_views(_text(name, "duck").strip(), *SHARED[name][0]) if SHARED[name][0] else _text(name, "duck").strip() for name in SHARED}
