"""Queries built from the operators' functions, each with a DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells, geometry, ids
from ..operators import cluster, graph, retrieval, rules, sequences, timing
from ..views import view, with_views

POLICY = rules.Policy(
    [rules.Zone("loading", [(0.2, 0.2), (0.6, 0.2), (0.6, 0.6), (0.2, 0.6)], True), rules.Zone("yard", [(0.5, 0.5), (0.9, 0.5), (0.9, 0.9), (0.5, 0.9)])],
    [rules.Line("entry", (0.5, 0.0), (0.5, 1.0))], 2, 3_600_000,
)
#: Cases for the oracle: the same policy written out.
_BASE = """
WITH o AS (SELECT *, x + w / 2 AS px, y + h / 2 AS py FROM obs),
n AS (SELECT camera, track_id FROM obs GROUP BY camera, track_id HAVING count(*) >= 2),
z AS (SELECT *, px >= 2e-1 AND px < 6e-1 AND py >= 2e-1 AND py < 6e-1 AS in1, px >= 5e-1 AND px < 9e-1 AND py >= 5e-1 AND py < 9e-1 AS in2, -(px - 5e-1) AS side FROM o),
l AS (SELECT *, lag(in1, 1, false) OVER k AS was1, lag(in2, 1, false) OVER k AS was2, lag(side) OVER k AS was FROM z WINDOW k AS (PARTITION BY camera, track_id ORDER BY t, seq)),
e AS (SELECT camera, track_id, t, seq, CASE WHEN in1 THEN 'restricted_zone_occupied' ELSE 'object_exited_zone' END AS event_type, 'loading' AS zone_id, CAST(NULL AS VARCHAR) AS line_id, CAST(NULL AS VARCHAR) AS direction FROM l WHERE in1 <> was1
 UNION ALL SELECT camera, track_id, t, seq, CASE WHEN in2 THEN 'object_entered_zone' ELSE 'object_exited_zone' END, 'yard', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM l WHERE in2 <> was2
 UNION ALL SELECT camera, track_id, t, seq, 'line_crossed', CAST(NULL AS VARCHAR), 'entry', CASE WHEN was > 0 THEN 'inbound' ELSE 'outbound' END FROM l WHERE abs(was) > 1e-4 AND abs(side) > 1e-4 AND sign(was) <> sign(side)),
v AS (SELECT camera, track_id, array_to_string(list_sort(list(DISTINCT zone_id)), ',') AS zones FROM e WHERE event_type IN ('restricted_zone_occupied', 'object_entered_zone') GROUP BY camera, track_id),
s AS (SELECT camera, track_id, min(t) AS started_at_ms, max(t) AS ended_at_ms, count(*) AS observations, round(max(conf), 6) AS maximum_confidence, arg_max(seq, t * 1000000 + seq % 1000000) AS last_seq FROM obs GROUP BY camera, track_id HAVING count(*) >= 2),
c AS (SELECT camera, track_id, class_name FROM (SELECT *, row_number() OVER (PARTITION BY camera, track_id ORDER BY weight DESC, class_name) AS rn FROM (SELECT camera, track_id, class_name, round(sum(conf), 9) AS weight FROM obs GROUP BY ALL) q) r WHERE rn = 1),
d AS (SELECT s.camera, s.track_id, ended_at_ms AS t, last_seq AS seq, 'dwell_threshold_exceeded' AS event_type, split_part(v.zones, ',', 1) AS zone_id, CAST(NULL AS VARCHAR) AS line_id, CAST(NULL AS VARCHAR) AS direction FROM s LEFT JOIN v ON v.camera = s.camera AND v.track_id = s.track_id WHERE ended_at_ms - started_at_ms >= 3600000),
a AS (SELECT * FROM e UNION ALL SELECT * FROM d), r AS (SELECT a.*, c.class_name FROM a JOIN n ON n.camera = a.camera AND n.track_id = a.track_id JOIN c ON c.camera = a.camera AND c.track_id = a.track_id)
"""


def rule_zone_line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.events(rules.validated(view(spark, sf_dir, "obs")), POLICY, ["camera"]).select("camera", "track_id", "t", "seq", "event_type", "zone_id", "line_id", "direction", "class_name")


def uuid5_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.events(view(spark, sf_dir, "obs"), POLICY, ["camera"]).select("event_id", "camera", "track_id", "event_type")


def rule_track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.summaries(view(spark, sf_dir, "obs"), POLICY, ["camera"])
    return rows.select("camera", "track_id", "class_name", "started_at_ms", "ended_at_ms", "duration_ms", "observations", F.round("maximum_confidence", 6).alias("maximum_confidence"), F.array_join("zones_visited", ",").alias("zones"))


def polygon_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, py = geometry.center(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return view(spark, sf_dir, "obs").select("seq", geometry.in_polygon(px, py, [(0.1, 0.1), (0.9, 0.3), (0.4, 0.8)]).alias("inside"))


def _edge(a: tuple[float, float], b: tuple[float, float]) -> str:
    return f"CASE WHEN ({a[1]:e} > py) <> ({b[1]:e} > py) AND px < ({b[0]:e} - {a[0]:e}) * (py - {a[1]:e}) / ({b[1]:e} - {a[1]:e}) + {a[0]:e} THEN 1 ELSE 0 END"


def appearance_prototype(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select(F.col("vec_id").alias("v"), F.col("embedding").alias("appearance"))
    number = table.agg((F.max("vec_id") + 1).alias("number"))
    obs = view(spark, sf_dir, "obs").join(F.broadcast(number), F.lit(True)).withColumn("v", F.col("seq") % F.col("number")).join(vectors, "v")
    return rules.prototype(obs, ["camera"]).select("camera", "track_id", F.posexplode("prototype").alias("pos", "v")).select("camera", "track_id", F.col("pos").cast("bigint").alias("pos"), F.round("v", 6).alias("v"))


def hilbert_cell64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.cells(view(spark, sf_dir, "trajectories"), "lat", "lng", 12).select("event_id", "hilbert", "cell")


def _first(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows, rows.where("vec_id = 0").first()["embedding"]


def ann_sign_shortlist_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _first(spark, sf_dir)
    return retrieval.nearest_by_signs(rows, "vec_id", "embedding", q)


def exact_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = _first(spark, sf_dir)
    return retrieval.nearest(rows, "vec_id", "embedding", q)


def lexical_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_frequency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text")


def lexical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", ["license", "token", "moving", "worthless"])


def numeric_grounding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(retrieval.numbers(F.col("text"))).cast("bigint").alias("numbers"), retrieval.grounded(F.col("text"), F.lit("2 events, 10 observations, 2004, version 2.0")).alias("grounded"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn").distinct()
    node = F.col("conv_id") * 100 + F.col("turn")
    a = turns.select(node.alias("source"), (node + 1).alias("target"))
    have = turns.select(node.alias("target"))
    temporal = a.join(have, "target").select("source", "target", F.lit("temporal").alias("kind"), F.when(F.col("source") % 5 == 0, 0.5).otherwise(0.95).alias("weight"))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label")
    w = v.select((F.col("vec_id") - 10).alias("vec_id"), F.col("vec_id").alias("target"), "label")
    bridge = v.join(w, ["vec_id", "label"]).select(F.col("vec_id").alias("source"), "target", F.lit("bridge").alias("kind"), F.lit(0.85).alias("weight"))
    return graph.both_ways(temporal.unionByName(bridge))


_EDGES = """
WITH tn AS (SELECT DISTINCT conv_id * 100 + turn AS n FROM conversations), te AS (SELECT a.n AS source, b.n AS target, CASE WHEN a.n % 5 = 0 THEN 5e-1 ELSE 95e-2 END AS weight FROM tn a JOIN tn b ON b.n = a.n + 1),
be AS (SELECT a.vec_id AS source, b.vec_id AS target, 85e-2 AS weight FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10),
ed AS (SELECT DISTINCT source, target FROM (SELECT * FROM te UNION ALL SELECT * FROM be UNION ALL SELECT target, source, weight FROM be) q WHERE weight >= 7e-1),
bfs AS (SELECT n AS node, 0 AS depth FROM tn WHERE {anchor} UNION SELECT ed.target, depth + 1 FROM bfs JOIN ed ON ed.source = bfs.node WHERE depth < 2),
reached AS (SELECT node, min(depth) AS depth FROM bfs GROUP BY node)
"""


def graph_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    anchors = turns.where("role = 'user' AND turn = 0").select((F.col("conv_id") * 100 + F.col("turn")).alias("node"))
    return graph.traversed(_edges(spark, sf_dir), anchors)


def video_rag_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    node = F.col("conv_id") * 100 + F.col("turn")
    clips = turns.select(node.alias("clip_id"), F.array(F.when(node % 700 == 0, "vehicle").otherwise("tree"), F.when(node % 3 == 0, "pedestrian").otherwise("bin")).alias("entities"))
    return graph.keyframes(clips, _edges(spark, sf_dir), ["vehicle"], True)


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id"), F.col("embedding").alias("prototype"), F.col("label"))
    return v.select((F.col("vec_id") % 3).cast("int").alias("camera"), F.concat(F.lit("t"), F.col("vec_id")).alias("track_id"), F.col("label").cast("string").alias("class_name"), (F.col("vec_id") * 50).alias("t0"), (F.col("vec_id") * 50 + 400).alias("t1"), (0.5 + (F.col("vec_id") % 10) / 20.0).alias("conf"), "prototype")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.sql("SELECT * FROM VALUES (0, 'e0', 1, 2, 'transition', 0L, 5000L, 0.9D), (1, 'e1', 2, 0, 'transition', 200L, 3000L, 0.5D) AS r(nth, edge_id, source, target, kind, low, high, edge)")
    cameras = spark.sql("SELECT * FROM VALUES (0, 'gate'), (1, 'gate'), (2, ''), (0, 'hall'), (2, 'hall') AS c(camera, group)")
    return cluster.relations(edges, cameras)


def association_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relations(spark, sf_dir)


def camera_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("camera"), F.col("n_regionkey").cast("string").alias("group"))
    none = spark.sql("SELECT 0 AS nth, '' AS edge_id, 0 AS source, 0 AS target, '' AS kind, 0 AS low, 0 AS high, 0 AS edge").limit(0)
    return cluster.relations(none, nations).select("relation", "edge_id", "source", "target")


def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.get(F.array(*map(F.lit, [0, -1_800_000, 250, -2_000_000_000])), F.col("camera").cast("int"))
    return view(spark, sf_dir, "obs").select("seq", cluster.shifted(F.col("t"), offset).alias("corrected"))


def association_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.candidates(_relations(spark, sf_dir), _tracks(spark, sf_dir), 0.30)
    return rows.select("relation", "s_track_id", "t_track_id", F.round("temporal", 6).alias("temporal"), F.round("appearance", 6).alias("appearance"), F.round("score", 6).alias("score"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*cluster.PAIR, "kind", "appearance", "temporal"]
    return cluster.assigned(cluster.candidates(_relations(spark, sf_dir), _tracks(spark, sf_dir), 0.30).select(*columns), 0.30)


def association_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select(*cluster.PAIR)


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.decisions(_pairs(spark, sf_dir), rules.NIL, 0.60, 0.45).withColumn("job", F.lit(0))


def association_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("association_id", "relation", "s_track_id", "t_track_id", "state", "explanation")


def _merged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    tracks, found = _tracks(spark, sf_dir).withColumn("job", F.lit(0)), _decisions(spark, sf_dir)
    return tracks, found, cluster.merged(tracks, found, "job")


def global_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster.identities(*_merged(spark, sf_dir), "job", rules.NIL)
    return rows.select("global_id", "state", F.round("confidence", 6).alias("confidence"), F.array_join("cameras", ",").alias("cameras"), F.array_join(F.transform("segments", lambda s: s["track_id"]), ",").alias("segments"), F.array_join("associations", ",").alias("associations"))


def cluster_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks, found, merged = _merged(spark, sf_dir)
    cameras = tracks.groupBy("camera").agg(F.count("*").alias("tracks"), F.count_if(F.col("conf") > 0.7).alias("events"), F.sum(F.col("t1") - F.col("t0")).alias("observations"))
    return cluster.report(cameras, found, merged)


def view_description_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    odd = F.col("n_nationkey") % 3 == 0
    return cluster.view_descriptions(n.select(F.col("n_nationkey").alias("nth"), F.col("n_name").alias("label"), F.col("r_name").alias("scene_type"), F.repeat(F.concat("n_name", F.lit(" ")), F.col("n_nationkey") * 4).alias("description"), F.array(F.col("r_name"), F.lit("road"), F.lit("sky")).alias("areas"), (F.col("n_nationkey") / 25).alias("confidence"), odd.alias("generated"), F.concat(F.lit("m"), (F.col("n_nationkey") % 2).cast("string")).alias("model"), F.when(~odd, "offline").alias("fallback")))


def visual_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    pick = lambda family, k: F.get(F.array(*map(F.lit, retrieval.STATES[family])), F.pmod(n.bitwiseXOR(F.lit(k)), F.lit(len(retrieval.STATES[family]))).cast("int"))
    moves = {f: retrieval.transition(f, pick(f, 0), pick(f, 5)) for f in retrieval.STATES}
    near = retrieval.state_gate("camera_distance", pick("camera_distance", 0), pick("camera_distance", 5), F.when(n % 7 == 0, "unclear").otherwise("same"), n % 5 != 0, F.when(n % 3 == 0, "receding").otherwise("approaching"), F.when(n % 4 != 0, F.col("value") / 20))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", *[c.alias(f) for f, c in moves.items()], near.alias("gate"))


def scene_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [F.col("event_type"), F.get(F.array(*map(F.lit, ["pushes", "stands near", "strikes", "holds"])), (F.col("user_id") % 4).cast("int")), F.lit("person")]
    triple = F.struct(words[0].alias("subject"), words[1].alias("relationship"), words[2].alias("object"))
    moves, hazards = retrieval.scene_graph(F.array(triple, triple.withField("relationship", F.lit("pushing"))))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.array_join(F.transform(moves, lambda m: m["to_state"]), ";").alias("moves"), F.array_join(hazards, ";").alias("hazards"))


def decode_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "memory_events")
    lo, hi = retrieval.interpretation_window(F.col("start_ms"), F.col("end_ms"), F.lit(2_000_000_000))
    mid = retrieval.midpoints(F.col("start_ms"), F.col("end_ms"), 4)
    times = F.transform(mid, lambda x: F.floor(x))
    return e.select("event_id", lo.alias("lo"), hi.alias("hi"), F.round(F.get(mid, F.lit(2)), 3).alias("third"), retrieval.grouped_decode(times, F.col("end_ms"), 256).alias("small"), retrieval.grouped_decode(times, F.col("end_ms"), 1100).alias("large"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "obs").select("camera", "seq", (F.row_number().over(_by_camera()) * 500).cast("bigint").alias("t"), F.col("conf").alias("activity"), F.col("x").alias("quality"))
    return timing.adaptive_threshold(rows, "camera")


def _by_camera():
    from pyspark.sql import Window

    return Window.partitionBy("camera").orderBy("t", "seq")


def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir).select("camera", "seq", F.round("threshold", 6).alias("threshold"))


def event_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.segmented(_frames(spark, sf_dir), "camera")


def diverse_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_segmentation(spark, sf_dir).withColumn("signature", F.array(F.col("activity_mean"), F.sqrt(1 - F.col("activity_mean") * F.col("activity_mean"))))
    return sequences.diverse(found, "camera", 6)


def privacy_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct("x", "y", "w", "h", "conf")
    rows = view(spark, sf_dir, "obs").groupBy("camera", F.floor(F.col("t") / 3_600_000).alias("t")).agg(F.sort_array(F.collect_list(one)).alias("detections"))
    return sequences.privacy_masks(rows, "camera")


def kept_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.kept_samples(view(spark, sf_dir, "obs").select("track_id", "t", "seq"), "track_id", 3_600_000).select("track_id", "t", "seq")


QUERIES = {f.__name__: f for f in (rule_zone_line_events, uuid5_event_ids, rule_track_summary, polygon_membership, appearance_prototype, hilbert_cell64, ann_sign_shortlist_rescore, exact_cosine_topk, lexical_df, lexical_topk, numeric_grounding_gate, graph_bfs, video_rag_keyframes, association_relations, camera_overlap_pairs, clock_offset, association_candidates, association_assignment, association_decisions, global_tracks, cluster_report, view_description_rollup, visual_states, scene_graphs, decode_plans, adaptive_threshold, event_segmentation, diverse_selection, privacy_masks, kept_samples)}

_STOP = ", ".join(f"'{w}'" for w in retrieval.STOP_WORDS)
_TERMS = rf"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda t: strlen(t) > 1 AND t NOT IN ({_STOP})))"
_ASKED = retrieval.expanded(["license", "token", "moving", "worthless"])
_RELATIONS = """WITH c AS (SELECT * FROM (VALUES (0, 'gate'), (1, 'gate'), (0, 'hall'), (2, 'hall')) v(camera, g)), rel AS (SELECT '0:000000000' || nth AS relation, edge_id, source, target, kind, CAST(low AS BIGINT) AS low, CAST(high AS BIGINT) AS high, CAST(edge AS DOUBLE) AS edge FROM (VALUES (0, 'e0', 1, 2, 'transition', 0, 5000, 0.9), (1, 'e1', 2, 0, 'transition', 200, 3000, 0.5)) v(nth, edge_id, source, target, kind, low, high, edge)
 UNION ALL SELECT '1:' || a.g || ':' || a.camera || ':' || b.camera, 'overlap-group:' || a.g, a.camera, b.camera, 'overlap', 0, 1500, 1.0 FROM c a JOIN c b ON a.g = b.g AND a.camera < b.camera) """
_COS = "(SELECT list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))))"
_NUMBERS = r"regexp_extract_all(text, '\b\d+(?:\.\d+)?\b')"

SQL = {
    "rule_zone_line_events": with_views(_BASE + "SELECT camera, track_id, t, seq, event_type, nullif(zone_id, '') AS zone_id, line_id, direction, class_name FROM r", "obs"),
    "uuid5_event_ids": with_views(_BASE + f""", i AS (SELECT camera, track_id, event_type, sha1(unhex('{ids.OID.replace("-", "")}') || encode('{rules.NIL}:' || event_type || ':' || track_id || ':' || t || ':' || coalesce(zone_id, '') || ':' || coalesce(line_id, ''))) AS d FROM r)
SELECT substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || lower(hex((CAST('0x' || substr(d, 17, 2) AS INT) & 63) | 128)) || substr(d, 19, 2) || '-' || substr(d, 21, 12) AS event_id, camera, track_id, event_type FROM i""", "obs"),
    "rule_track_summary": with_views(_BASE + "SELECT s.camera, s.track_id, class_name, started_at_ms, ended_at_ms, ended_at_ms - started_at_ms AS duration_ms, observations, maximum_confidence, coalesce(zones, '') AS zones FROM s JOIN c ON c.camera = s.camera AND c.track_id = s.track_id LEFT JOIN v ON v.camera = s.camera AND v.track_id = s.track_id", "obs"),
    "polygon_membership": with_views(f"SELECT seq, ({_edge((0.1, 0.1), (0.9, 0.3))} + {_edge((0.9, 0.3), (0.4, 0.8))} + {_edge((0.4, 0.8), (0.1, 0.1))}) % 2 = 1 AS inside FROM (SELECT seq, x + w / 2 AS px, y + h / 2 AS py FROM obs) q", "obs"),
    "appearance_prototype": with_views("""WITH p AS (SELECT camera, track_id, unnest(range(0, 64)) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS v, greatest(conf, 5e-2) AS weight FROM obs JOIN embeddings ON vec_id = seq % (SELECT max(vec_id) + 1 FROM embeddings)),
s AS (SELECT camera, track_id, pos, sum(v * weight) AS v FROM p GROUP BY ALL), n AS (SELECT camera, track_id, sqrt(sum(v * v)) AS norm FROM s GROUP BY ALL) SELECT s.camera, s.track_id, pos, round(v / norm, 6) AS v FROM s JOIN n ON n.camera = s.camera AND n.track_id = s.track_id""", "obs"),
    "hilbert_cell64": with_views("""WITH g AS (SELECT event_id, CAST(floor((lng + 180) / 360e0 * 16777215) AS BIGINT) AS x, CAST(floor((lat + 90) / 180e0 * 16777215) AS BIGINT) AS y FROM trajectories),
w AS (SELECT event_id, x, y, 23 AS k, CAST(0 AS BIGINT) AS d FROM g UNION ALL
 SELECT event_id, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 16777215 - y ELSE y END ELSE x END, CASE WHEN ry = 0 THEN CASE WHEN rx = 1 THEN 16777215 - x ELSE x END ELSE y END, k - 1, d + (CAST(1 AS BIGINT) << (2 * k)) * xor(3 * rx, ry)
 FROM (SELECT *, (x >> k) & 1 AS rx, (y >> k) & 1 AS ry FROM w WHERE k >= 0) q)
SELECT event_id, d AS hilbert, (CAST(1 AS BIGINT) << 59) | (CAST(12 AS BIGINT) << 52) | (((d >> 45) & 127) << 45) | ((d >> 3) & 35184372088831) AS cell FROM w WHERE k = -1""", "trajectories"),
    "ann_sign_shortlist_rescore": f"""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), h AS (SELECT vec_id, embedding, (SELECT CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (e.embedding[i] > 0) <> (q.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INT) FROM q) AS hamming FROM embeddings e ORDER BY hamming, vec_id LIMIT 25)
SELECT vec_id, hamming, round({_COS}, 6) AS cosine FROM h e, q ORDER BY cosine DESC, vec_id LIMIT 10""",
    "exact_cosine_topk": f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0) SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings e, q ORDER BY cosine DESC, vec_id LIMIT 10",
    "lexical_df": f"SELECT term, count(*) AS df FROM (SELECT unnest({_TERMS}) AS term FROM documents) q GROUP BY term",
    "lexical_topk": f"""WITH h AS (SELECT doc_id, unnest(list_intersect({_TERMS}, {_ASKED!r})) AS term FROM documents), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
SELECT doc_id, round(sum(ln(((SELECT count(*) FROM documents) + 1e0) / (df + 1)) + 1) / {len(_ASKED)}, 6) AS score FROM h JOIN f ON f.term = h.term GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""",
    "numeric_grounding_gate": f"SELECT doc_id, CAST(len({_NUMBERS}) AS BIGINT) AS numbers, len(list_filter({_NUMBERS}, lambda n: n NOT IN ('2', '10', '2004', '2.0'))) = 0 AS grounded FROM documents",
    "graph_bfs": "WITH RECURSIVE " + _EDGES.lstrip()[5:].replace("{anchor}", "n IN (SELECT conv_id * 100 FROM conversations WHERE role = 'user' AND turn = 0)") + "SELECT node, depth FROM reached",
    "video_rag_keyframes": "WITH RECURSIVE " + _EDGES.lstrip()[5:].replace("{anchor}", "n % 700 = 0") + "SELECT node AS clip_id, round(least(1, 6e-1 + CASE WHEN node % 700 = 0 THEN 35e-2 ELSE 0 END), 6) AS score FROM reached JOIN tn ON tn.n = reached.node ORDER BY score DESC, clip_id LIMIT 14",
    "association_relations": _RELATIONS + "SELECT * FROM rel",
    "camera_overlap_pairs": "SELECT '1:' || a.n_regionkey || ':' || a.n_nationkey || ':' || b.n_nationkey AS relation, 'overlap-group:' || a.n_regionkey AS edge_id, a.n_nationkey AS source, b.n_nationkey AS target FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "clock_offset": with_views("SELECT seq, CASE camera WHEN 0 THEN t WHEN 1 THEN greatest(0, t - 1800000) WHEN 2 THEN t + 250 ELSE greatest(0, t - 2000000000) END AS corrected FROM obs", "obs"),
    "association_candidates": _RELATIONS + f""", tr AS (SELECT vec_id, CAST(vec_id % 3 AS INT) AS camera, 't' || vec_id AS track_id, label, vec_id * 50 AS t0, vec_id * 50 + 400 AS t1, 5e-1 + (vec_id % 10) / 20e0 AS conf, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
p AS (SELECT rel.*, s.track_id AS s_track_id, t.track_id AS t_track_id, greatest(0, least(1, list_dot_product(s.embedding, t.embedding) / (sqrt(list_dot_product(s.embedding, s.embedding)) * sqrt(list_dot_product(t.embedding, t.embedding))))) AS appearance, sqrt(s.conf * t.conf) AS q,
  CASE WHEN kind = 'overlap' THEN greatest(0, 1 - greatest(t.t0 - s.t1, s.t0 - t.t1, 0) / 1500e0) WHEN t.t0 - s.t1 < greatest(low, 0) OR t.t0 - s.t1 > high THEN 0 ELSE greatest(5e-2, least(1, 1 - abs(t.t0 - s.t1 - (low + high) / 2e0) / (greatest(high - low, 1) / 2e0))) END AS temporal
  FROM rel JOIN tr s ON s.camera = rel.source JOIN tr t ON t.camera = rel.target AND t.label = s.label)
SELECT relation, s_track_id, t_track_id, round(temporal, 6) AS temporal, round(appearance, 6) AS appearance, round(greatest(0, least(1, CASE WHEN kind = 'overlap' THEN 7e-1 * appearance + 2e-1 * temporal + 1e-1 * q ELSE 65e-2 * appearance + 2e-1 * temporal + 1e-1 * q + 5e-2 * edge END)), 6) AS score FROM p WHERE appearance >= 3e-1 AND temporal > 0""",
    "view_description_rollup": """WITH c AS (SELECT n_nationkey AS k, n_name AS label, r_name AS scene, repeat(n_name || ' ', n_nationkey * 4) AS d, n_nationkey % 3 = 0 AS g FROM nation JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT label || ': ' || area AS area, row_number() OVER (ORDER BY k, nth) AS rn FROM (SELECT k, label, unnest([scene, 'road', 'sky']) AS area, unnest([1, 2, 3]) AS nth FROM c) q)
SELECT string_agg(label || ' (' || scene || '): ' || CASE WHEN length(d) > 420 THEN substr(d, 1, 420) || '…' ELSE d END, ' ' ORDER BY k) AS description, (SELECT string_agg(area, '; ' ORDER BY rn) FROM a WHERE rn <= 48) AS areas, round(avg(CASE WHEN g THEN k / 25e0 END), 6) AS confidence, true AS generated, 'm0, m1' AS model, string_agg(label || ': offline', '; ' ORDER BY k) FILTER (WHERE NOT g) AS fallback FROM c""",
    "visual_states": """WITH e AS (SELECT event_id, value, event_id % 4 AS d0, xor(event_id, 5) % 4 AS d1, event_id % 3 AS s0, xor(event_id, 5) % 3 AS s1 FROM events),
m AS (SELECT *, CASE WHEN d0 = 3 OR d1 = 3 OR d0 = d1 THEN 0 WHEN d1 > d0 THEN 1 ELSE -1 END AS d, CASE WHEN s0 = 2 OR s1 = 2 OR s0 = s1 THEN 0 WHEN s1 > s0 THEN 1 ELSE -1 END AS s FROM e)
SELECT event_id, CASE d WHEN 1 THEN 'opening' WHEN -1 THEN 'closing' END AS door_openness, CASE s WHEN 1 THEN 'placing' WHEN -1 THEN 'removing' END AS support_relation, CASE s WHEN 1 THEN 'arriving' WHEN -1 THEN 'leaving' END AS region_membership, CASE d WHEN 1 THEN 'approaching' WHEN -1 THEN 'receding' END AS camera_distance,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 AND d = CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AND (event_id % 4 = 0 OR (d = 1 AND value / 20 >= 115e-2) OR (d = -1 AND value / 20 <= 1 / 115e-2)) THEN 'passed' ELSE 'rejected' END AS gate FROM m""",
    "scene_graphs": """WITH e AS (SELECT event_id, event_type, user_id % 4 AS k FROM events) SELECT event_id, CASE k WHEN 0 THEN event_type || ' pushes person;' WHEN 2 THEN event_type || ' strikes person;' ELSE '' END || event_type || ' pushing person' AS moves, CASE WHEN k IN (0, 2) THEN repeat('Physical altercation anticipated within 3000ms between ' || event_type || ' and person;', 1) ELSE '' END || 'Physical altercation anticipated within 3000ms between ' || event_type || ' and person' AS hazards FROM e""",
    "decode_plans": with_views("""SELECT event_id, greatest(start_ms - 2000, 0) AS lo, least(end_ms + 2000, greatest(start_ms - 2000, 0) + 20000, 2000000000 + greatest(0, end_ms - 2000000000)) AS hi, round(start_ms + 625e-3 * (end_ms - start_ms), 3) AS third,
  end_ms - floor(start_ms + (end_ms - start_ms) / 8e0) <= 20000 AS small, false AS large FROM memory_events""", "memory_events"),
    "adaptive_threshold": with_views("""SELECT camera, seq, round(CASE WHEN n < 4 THEN 18e-2 ELSE least(55e-2, greatest(1e-1, mid + greatest(5e-2, 35e-1 * list_median(list_transform(past, lambda v: abs(v - mid)))))) END, 6) AS threshold
FROM (SELECT camera, seq, past, coalesce(len(past), 0) AS n, list_median(past) AS mid FROM (SELECT camera, seq, list(conf) OVER (PARTITION BY camera ORDER BY t, seq ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS past FROM obs) q) r""", "obs"),
    "kept_samples": with_views("""WITH k AS (SELECT track_id, min(t) AS t FROM obs GROUP BY track_id UNION ALL SELECT k.track_id, (SELECT min(o.t) FROM obs o WHERE o.track_id = k.track_id AND o.t >= k.t + 3600000) FROM k WHERE EXISTS (SELECT 1 FROM obs o WHERE o.track_id = k.track_id AND o.t >= k.t + 3600000))
SELECT k.track_id, k.t, min(o.seq) AS seq FROM k JOIN obs o ON o.track_id = k.track_id AND o.t = k.t GROUP BY k.track_id, k.t""", "obs"),
}
