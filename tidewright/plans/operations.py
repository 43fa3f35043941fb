"""Queries of the control plane and of comparisons, over records derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, sequences
from ..views import view, with_views
from . import frames

_POOL = ["start", "finish", "cancel", "resume", "fail"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders")


def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    return o.select("o_orderkey", control.profile_fingerprint(status, F.create_map(F.lit("z"), F.col("o_orderpriority"), F.lit("a"), status)).alias("profile"), control.artifact_key(status, key, key + 5, F.lit("v1")).alias("artifact"), control.request_fingerprint(status, ["o_custkey", "o_orderpriority"]).alias("request"), control.request_fingerprint(status, ["o_custkey"], F.lit("p")).alias("profiled"))


def index_job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("job"), F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_orderstatus").alias("sha"), F.lit(1).alias("start_ms"), F.col("o_orderkey").alias("end_ms"))
    return control.index_job_id(o, "scope", "policy", "v1")


def idempotent_submit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    rows = o.select((F.col("o_custkey") % 100).alias("queue"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey").cast("string")).alias("key"), control.request_fingerprint(F.lit("open"), ["o_orderstatus"]).alias("fingerprint"), F.when(F.col("o_orderpriority") == "5-LOW", "name").otherwise("").alias("violations"))
    return control.submitted(rows).select("queue", "seq", "outcome")


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.get(F.array(*map(F.lit, _POOL)), (F.floor(F.col("o_totalprice")) % 5).cast("int"))
    return control.job_states(_orders(spark, sf_dir).select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("seq"), action.alias("action")))


def pruned_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return control.pruned(_orders(spark, sf_dir).select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created"), state.alias("state")), 5).select("owner", "job", "state")


def cluster_job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("camera"), F.when(F.col("o_orderstatus") == "F", "lost").alias("error"), (F.col("o_orderkey") % 7).alias("tracks"), (F.col("o_orderkey") % 11).alias("events"), (F.col("o_orderkey") * 10).alias("duration_ms"))
    return control.cluster_totals(rows)


def revocation_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    sources = li.where("l_linenumber > 1").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("key"), F.col("l_suppkey").alias("path"))
    gone = _table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("path"))
    return control.surviving_artifacts(li.select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("key")).distinct(), sources, gone)


def revocation_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return control.readable(view(spark, sf_dir, "memory_events").select("event_id", "camera"), gone, "event_id")


def revocation_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.witnessed(_orders(spark, sf_dir).select(F.col("o_custkey").alias("scope"), (F.col("o_orderkey") % 9).alias("revision"), F.col("o_orderstatus").alias("digest")))


def revocation_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    targets = o.select(F.col("o_orderkey").alias("scope"), F.lit("index").alias("target"), (F.col("o_orderkey") % 4).alias("revision"), (F.col("o_orderkey") % 6).alias("attempts"), (F.col("o_orderkey") * 10).alias("tried_at"))
    receipts = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("scope"), F.lit("index").alias("target"), (F.col("o_orderkey") % 3).alias("revision"))
    return control.dispatches(targets, receipts, 60_000).select("scope", "state")


def _projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    expected = o.where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("key"), F.md5("o_orderstatus").alias("fingerprint"))
    stored = o.where("o_orderkey % 10 <> 2").select(F.col("o_orderkey").alias("key"), F.md5(F.when(F.col("o_orderkey") % 10 == 3, "x").otherwise(F.col("o_orderstatus"))).alias("fingerprint"))
    return control.verified(expected, stored, "key")


def projection_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projections(spark, sf_dir)


def projection_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.replays(_projections(spark, sf_dir).withColumn("due_at", (F.col("key") * 7919) % 1000), 900).select("key", "state")


def admission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.admitted(_orders(spark, sf_dir).select(F.col("o_custkey").alias("gate"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") != "P").alias("interactive")))


def index_queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("state"), (F.col("o_orderkey") % 4).alias("attempts"), (F.col("o_orderkey") % 3 == 0).alias("permanent"), F.col("o_orderdate").alias("updated"))
    return control.queue_steps(rows)


def index_job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("job"), F.col("o_orderkey").alias("item"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderkey") % 2 == 0, "running").otherwise("failed").alias("state"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 1), F.concat(F.lit("e"), F.col("o_orderkey").cast("string"))).alias("error"), (F.col("o_orderkey") % 13 != 0).alias("artifact_ok"))
    return control.index_jobs(rows)


def deployment_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 40 + 1).alias("generation")).distinct()
    g = F.col("generation")
    rows = rows.select("name", "generation", F.when(g % 6 == 0, "short").otherwise(F.sha2((g % 9).cast("string"), 256)).alias("fingerprint"), F.when(g % 4 == 0, "").otherwise("r").alias("receipt"), (g % 5 == 0).alias("active"))
    return control.deployments(rows)


def storage_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store"), (F.col("s_suppkey") % 4).alias("version"), F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("wal"))).otherwise(F.array(F.lit("fence"), F.lit("wal"), F.lit("x"))).alias("features"), (F.col("s_acctbal") < 0).alias("fenced"))
    return control.storage_contracts(rows)


def experiment_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir).select((F.col("o_orderkey")).alias("case"), (F.col("o_orderkey") % 2).alias("repeat"), F.array("o_orderstatus", "o_orderpriority").alias("ranking"), F.col("o_custkey").alias("metric"), F.col("o_totalprice").alias("note"), F.rand(1).alias("elapsed"))
    odd = lambda c, k, other: F.when(F.col("case") % k == 0, other).otherwise(F.col(c)).alias(c)
    other = o.where("case % 31 <> 0").select("case", "repeat", odd("ranking", 7, F.reverse("ranking")), odd("metric", 5, F.lit(-1)), odd("note", 3, F.lit(0.0)), F.rand(2).alias("elapsed"))
    return control.compared(o.where("case % 29 <> 0"), other)


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    queries = o.select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % 4 != 0).alias("positive"))
    results = o.select(F.col("o_orderstatus").alias("mode"), F.col("o_orderkey").alias("query"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice") / 500000).alias("metric"), (F.col("o_orderkey") % 8).alias("returned"), (F.col("o_custkey") / 100).alias("latency"))
    return control.evaluation(results, queries)


def projection_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "memory_events").withColumns({"session": F.when(F.col("job") > 0, F.concat(F.lit("s"), F.col("job"))), "duration_ms": F.lit(2_500_000_000)})
    entities = e.where("quality > 5").select("camera", "session", (F.col("event_id") % 20).alias("entity_id"))
    return control.payloads(e, entities).select("camera", "session", F.md5("events").alias("events"), "entities", "violations")


def box_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = view(spark, sf_dir, "obs")
    boxes = obs.where("seq % 3 = 0").select("camera", F.floor(F.col("t") / 1000).alias("t"), F.floor(F.col("t") / 1000).cast("string").alias("box"))
    return control.aligned(obs.select("camera", "seq", F.floor(F.col("t") / 1000).alias("t")), boxes, ["camera"])


def detector_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.agreement_summary(_pairs(spark, sf_dir), "camera")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda dx: F.struct("class_name", (F.col("x") + dx).alias("x"), "y", "w", "h", "conf")
    return view(spark, sf_dir, "obs").groupBy("camera", F.floor(F.col("t") / 3_600_000).alias("frame")).agg(F.sort_array(F.collect_list(box(F.lit(0.0)))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("seq") % 5 != 0, box(F.col("conf") / 20)))).alias("b"))


def cell_footfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import cells

    rows = cells.cells(view(spark, sf_dir, "trajectories"), "lat", "lng", 3)
    asked = rows.where("event_id < 3").select("cell").distinct()
    return rows.join(F.broadcast(asked), "cell", "left_semi").agg(F.count("*").alias("footfall"), F.countDistinct("track_id").alias("tracks"))


def grounded_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import history

    events = view(spark, sf_dir, "memory_events").select("event_id", "camera", "start_ms", "end_ms")
    shown = history.windows(events.orderBy("start_ms", "event_id").limit(3), 2_000_000_000)
    observed = history.observations(*history.near(view(spark, sf_dir, "obs"), events, shown))
    rows = history.grounding(shown, observed.where("class_name = 'click'"))
    return rows.select("event_id", "lo", "hi", F.size("boxes").alias("boxes"), F.array_join(F.array_sort(F.transform("boxes", lambda b: b["t"].cast("string"))), ",").alias("times"))


QUERIES = {f.__name__: f for f in (content_fingerprints, index_job_ids, idempotent_submit, job_states, pruned_jobs, cluster_job_totals, revocation_purge, revocation_antijoin, revocation_witness, revocation_dispatch, projection_verify, projection_replay, admission_order, index_queue_order, index_job_progress, deployment_registry, storage_contracts, experiment_pairs, eval_summary, projection_payloads, box_alignment, detector_agreement, cell_footfall, grounded_interpretations)}

_URL = "'6ba7b8119dad11d180b400c04fd430c8'"


def _uuid(name: str) -> str:
    from .stories import uuid5_sql

    return uuid5_sql(_URL, name)


def _grounded() -> str:
    from . import stories

    return stories._history("""SELECT e.event_id, lo, hi, CAST(count(DISTINCT o.t) AS INT) AS boxes, coalesce(string_agg(DISTINCT CAST(o.t AS VARCHAR), ',' ORDER BY CAST(o.t AS VARCHAR)), '') AS times FROM (SELECT event_id, camera, greatest(start_ms - 2000, 0) AS lo, least(end_ms + 2000, greatest(start_ms - 2000, 0) + 20000) AS hi FROM memory_events ORDER BY start_ms, event_id LIMIT 3) e
LEFT JOIN (SELECT * FROM observed WHERE class_name = 'click' AND conf IS NOT NULL) o ON o.camera = e.camera AND o.t >= lo AND o.t < hi GROUP BY e.event_id, lo, hi""")


def _cells() -> str:
    return frames.SQL["hilbert_cell64"].replace("CAST(12 AS BIGINT) << 52", "CAST(3 AS BIGINT) << 52").replace("((d >> 3) & 35184372088831)", "((d >> 12) & 35184372088831)")


SQL = {
    "grounded_interpretations": _grounded(),
    "cell_footfall": "WITH k AS (" + _cells() + ") SELECT count(*) AS footfall, count(DISTINCT user_id) AS tracks FROM k JOIN events ON events.event_id = k.event_id WHERE cell IN (SELECT cell FROM k WHERE event_id < 3)",
    "content_fingerprints": """SELECT o_orderkey, sha256('["' || o_orderstatus || '",{"a":"' || o_orderstatus || '","z":"' || o_orderpriority || '"}]') AS profile, sha256('["' || o_orderstatus || '", ' || o_orderkey || ', ' || (o_orderkey + 5) || ', "v1"]') AS artifact,
  sha256('["' || o_orderstatus || '",{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}]') AS request, sha256('["' || o_orderstatus || '",{"o_custkey":' || o_custkey || '}]|p') AS profiled FROM orders""",
    "index_job_ids": f"SELECT o_custkey AS job, {_uuid('digest')} AS job_id, items FROM (SELECT o_custkey, count(*) AS items, sha256('scope' || chr(10) || 'policy' || chr(10) || 'v1' || chr(10) || string_agg(item, chr(10) ORDER BY item)) AS digest FROM (SELECT o_custkey, o_orderkey || '|' || o_orderstatus || '|1|' || o_orderkey AS item FROM orders) i GROUP BY o_custkey) q",
    "idempotent_submit": """WITH r AS (SELECT o_custkey % 100 AS queue, o_orderkey AS seq, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS key, o_orderstatus AS f, o_orderpriority <> '5-LOW' AS sound FROM orders),
k AS (SELECT *, (SELECT arg_min(f, p.seq) FROM r p WHERE p.sound AND p.queue = r.queue AND p.key = r.key AND p.seq <= r.seq) AS first, key IS NULL OR NOT EXISTS (SELECT 1 FROM r p WHERE p.sound AND p.queue = r.queue AND p.key = r.key AND p.seq < r.seq) AS new FROM r),
c AS (SELECT *, sum(CASE WHEN sound AND new THEN 1 ELSE 0 END) OVER (PARTITION BY queue ORDER BY seq) AS place FROM k)
SELECT queue, seq, CASE WHEN NOT sound THEN 'invalid' WHEN key IS NOT NULL AND first <> f THEN 'conflict' WHEN NOT new THEN 'existing' WHEN place > 8 THEN 'full' ELSE 'created' END AS outcome FROM c""",
    "job_states": """WITH RECURSIVE a AS (SELECT o_custkey AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, ['start', 'finish', 'cancel', 'resume', 'fail'][CAST(floor(o_totalprice) AS BIGINT) % 5 + 1] AS action FROM orders),
w AS (SELECT job, CAST(0 AS BIGINT) AS n, 'queued' AS state, 0 AS refused FROM (SELECT DISTINCT job FROM a) j UNION ALL
 SELECT job, n, coalesce(new, state), refused + CASE WHEN new IS NULL THEN 1 ELSE 0 END FROM (SELECT w.job, a.n, state, refused, CASE state || '/' || action WHEN 'queued/start' THEN 'running' WHEN 'queued/cancel' THEN 'cancelled' WHEN 'running/finish' THEN 'completed' WHEN 'running/fail' THEN 'failed' WHEN 'running/cancel' THEN 'cancelled' WHEN 'cancelled/resume' THEN 'queued' WHEN 'failed/resume' THEN 'queued' END AS new FROM w JOIN a ON a.job = w.job AND a.n = w.n + 1) q)
SELECT job, arg_max(state, n) AS state, arg_max(refused, n) AS refused FROM w GROUP BY job""",
    "pruned_jobs": """WITH j AS (SELECT o_custkey AS owner, o_orderkey AS job, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS state, o_orderdate FROM orders)
SELECT owner, job, state FROM j WHERE state = 'running' OR (SELECT count(*) FROM j p WHERE p.owner = j.owner AND p.state <> 'running' AND (p.o_orderdate, p.job) <= (j.o_orderdate, j.job)) > (SELECT count(*) FROM j p WHERE p.owner = j.owner) - 5""",
    "cluster_job_totals": "SELECT o_custkey AS job, CASE WHEN count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) > 0 THEN 'completed' ELSE 'failed' END AS state, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS succeeded, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS failed, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 7 END), 0) AS BIGINT) AS tracks, CAST(coalesce(sum(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 11 END), 0) AS BIGINT) AS events, max(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey * 10 END) AS duration_ms FROM orders GROUP BY o_custkey",
    "revocation_purge": "SELECT DISTINCT l_returnflag AS kind, l_orderkey AS key FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber > 1 AND s.l_returnflag = a.l_returnflag AND s.l_orderkey = a.l_orderkey AND s.l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))",
    "revocation_antijoin": with_views("SELECT event_id, camera FROM memory_events WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", "memory_events"),
    "revocation_witness": """WITH l AS (SELECT o_custkey AS scope, o_orderkey % 9 AS revision, min(o_orderstatus) AS digest, count(DISTINCT o_orderstatus) > 1 AS twice FROM orders GROUP BY o_custkey, o_orderkey % 9)
SELECT scope, max(revision) AS revision, arg_max(digest, revision) AS digest, bool_or(twice) AS conflict FROM l GROUP BY scope""",
    "revocation_dispatch": "SELECT o_orderkey AS scope, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = o_orderkey % 4 THEN 'done' WHEN o_orderstatus = 'F' AND o_orderkey % 3 > o_orderkey % 4 THEN 'conflict' WHEN o_orderkey % 6 = 0 OR o_orderkey * 10 + 2000 * pow(2, o_orderkey % 6) <= 60000 THEN 'due' ELSE 'waiting' END AS state FROM orders",
    "projection_verify": "SELECT o_orderkey AS key, CASE o_orderkey % 10 WHEN 1 THEN 'stray' WHEN 2 THEN 'missing' WHEN 3 THEN 'changed' ELSE 'match' END AS state FROM orders",
    "projection_replay": "SELECT o_orderkey AS key, CASE o_orderkey % 10 WHEN 1 THEN 'stray' WHEN 2 THEN 'missing' ELSE 'changed' END AS state FROM orders WHERE o_orderkey % 10 IN (1, 2, 3) AND o_orderkey * 7919 % 1000 <= 900 ORDER BY o_orderkey * 7919 % 1000, o_orderkey LIMIT 2",
    "admission_order": """WITH k AS (SELECT o_custkey AS gate, o_orderkey AS seq, o_orderstatus <> 'P' AS i, row_number() OVER (PARTITION BY o_custkey, o_orderstatus <> 'P' ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT gate, seq, CASE WHEN n < 8 THEN row_number() OVER (PARTITION BY gate, n < 8 ORDER BY CASE WHEN i THEN n // 4 ELSE n END, CASE WHEN i THEN 0 ELSE 1 END, n) END AS place FROM k""",
    "index_queue_order": "SELECT queue, item FROM (SELECT o_custkey AS queue, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'O' OR (o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AND o_orderkey % 4 < 2)) q WHERE rn = 1",
    "index_job_progress": """WITH i AS (SELECT o_custkey AS job, o_orderkey AS item, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'failed' END AS s, row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'P' AND o_orderkey % 2 = 1 ORDER BY o_orderkey) AS nth FROM orders),
g AS (SELECT job, count(*) AS items, count(CASE WHEN s = 'done' AND item % 13 <> 0 THEN 1 END) AS done, count(CASE WHEN s = 'queued' THEN 1 END) AS queued, count(CASE WHEN s = 'running' THEN 1 END) AS running, count(CASE WHEN s = 'failed' THEN 1 END) AS failed, coalesce(string_agg('e' || item, ';' ORDER BY item) FILTER (WHERE s = 'failed' AND nth <= 10), '') AS errors FROM i GROUP BY job)
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN done = items THEN 'completed' WHEN running > 0 THEN 'running' ELSE 'queued' END AS state FROM g""",
    "deployment_registry": """WITH d AS (SELECT DISTINCT o_custkey AS name, o_orderkey % 40 + 1 AS generation FROM orders), w AS (SELECT *, lag(generation, 1, 0) OVER (PARTITION BY name ORDER BY generation) AS before, CASE WHEN generation % 6 = 0 THEN -1 ELSE generation % 9 END AS f, sum(CASE WHEN generation % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY name) AS live FROM d)
SELECT name, generation, array_to_string(list_filter([CASE WHEN generation <> before + 1 THEN 'generation' END, CASE WHEN f = -1 THEN 'fingerprint' END, CASE WHEN count(*) OVER (PARTITION BY name, f) > 1 THEN 'repeated' END, CASE WHEN generation % 20 = 0 THEN 'receipt' END, CASE WHEN live > 1 THEN 'active' END], lambda c: c IS NOT NULL), ',') AS violations FROM w""",
    "storage_contracts": "SELECT s_suppkey AS store, array_to_string(list_filter([CASE WHEN s_suppkey % 4 NOT IN (1, 2) THEN 'version' END, CASE WHEN s_suppkey % 3 = 0 THEN 'feature' END, CASE WHEN s_acctbal < 0 THEN 'fenced' END], lambda c: c IS NOT NULL), ',') AS violations FROM supplier",
    "experiment_pairs": """WITH o AS (SELECT o_orderkey AS k, o_orderstatus = o_orderpriority AS plain, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 29 <> 0 OR o_orderkey % 31 <> 0)
SELECT k AS "case", k % 2 AS repeat, k % 29 <> 0 AND k % 31 <> 0 AND k % 7 <> 0 AND k % 5 <> 0 AND k % 3 <> 0 AS exact, k % 29 <> 0 AND k % 31 <> 0 AND k % 7 <> 0 AS ranking, k % 29 <> 0 AND k % 31 <> 0 AND k % 5 <> 0 AS metric, k % 29 = 0 OR k % 31 = 0 AS missing FROM o""",
    "eval_summary": """SELECT o_orderstatus AS mode, count(*) AS attempted, count(CASE WHEN o_orderkey % 9 = 0 THEN 1 END) AS failed, round(sum(CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice / 500000 ELSE 0 END END) / (SELECT count(*) FROM orders WHERE o_orderkey % 4 <> 0), 6) AS mean,
  round(count(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 9 <> 0 AND o_orderkey % 8 = 0 THEN 1 END) / (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 0), 6) AS empty_rate, round(avg(o_custkey / 100), 6) AS latency FROM orders GROUP BY o_orderstatus""",
    "projection_payloads": with_views("""SELECT camera, CASE WHEN job > 0 THEN 's' || job END AS session, md5('[' || string_agg('{"start_ms":' || start_ms || ',"event_id":' || event_id || ',"end_ms":' || end_ms || '}', ',' ORDER BY start_ms, event_id) || ']') AS events, count(DISTINCT CASE WHEN quality > 5 THEN event_id % 20 END) AS entities, array_to_string(list_filter([CASE WHEN bool_or(end_ms > 2500000000) THEN 'interval' END], lambda c: c IS NOT NULL), ',') AS violations FROM memory_events GROUP BY camera, job""", "memory_events"),
    "box_alignment": with_views("""WITH b AS (SELECT DISTINCT camera, CAST(floor(t / 1000e0) AS BIGINT) AS t FROM obs WHERE seq % 3 = 0), n AS (SELECT o.camera, o.seq, CAST(floor(o.t / 1000e0) AS BIGINT) AS t FROM obs o)
SELECT n.camera, n.seq, n.t, CASE WHEN count(b.t) = 1 THEN CAST(max(b.t) AS VARCHAR) END AS box FROM n LEFT JOIN b ON b.camera = n.camera AND abs(b.t - n.t) <= 1 GROUP BY n.camera, n.seq, n.t""", "obs"),
}
