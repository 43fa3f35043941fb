"""Checks of requests and results. Each gives a row's violations, the codes of all rules it breaks, in the rules' order,
joined by commas; an empty string where it is sound. Rules over child rows are joins and windows, not loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def codes(rules: dict[str, Column]) -> Column:
    """rules: code -> condition that must not hold; an unknown condition doesn't count."""
    return F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()])), ",")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def outside(c: Column, low: float, high: float) -> Column:
    return F.coalesce(~c.between(low, high) | F.isnan(c.cast("double")), F.lit(True))


def scheme_missing(c: Column, *schemes: str) -> Column:
    out = F.lit(True)
    for s in schemes:
        out = out & ~F.startswith(c, F.lit(f"{s}://"))
    return out


def spaced(c: Column) -> Column:
    return c.rlike(r"\s")


def job_request(most_seconds: int = 3600) -> Column:
    """Columns name, fps, seconds, kind (sample, rtsp, http), uri, zones (array of struct id, points as array of [x, y])."""
    zones = F.col("zones")
    rtsp, http = F.col("kind") == "rtsp", F.col("kind") == "http"
    return codes({
        "name": blank(F.col("name")) | (F.octet_length("name") > 120),
        "fps": outside(F.col("fps"), 0.1, 60.0),
        "duration": outside(F.col("seconds"), 1, most_seconds),
        "scheme": (rtsp & scheme_missing(F.col("uri"), "rtsp", "rtsps")) | (http & scheme_missing(F.col("uri"), "http", "https")),
        "spaces": (rtsp | http) & spaced(F.col("uri")),
        "zone": F.exists(zones, lambda z: blank(z["id"]) | (F.size(z["points"]) < 3)),
        "geometry": F.exists(zones, lambda z: ~points_inside(z["points"])),
    })


def points_inside(points: Column) -> Column:
    """Whether all coordinates lie in 0..1."""
    return F.forall(points, lambda p: F.forall(p, lambda v: (v >= 0) & (v <= 1) & ~F.isnan(v.cast("double"))))


def cluster_requests(jobs: DataFrame, cameras: DataFrame, edges: DataFrame, most_cameras: int = 64) -> DataFrame:
    """job, violations. jobs: job, name, appearance, provisional, final, tolerance_ms. cameras: job, camera_id, uri,
    offset_ms. edges: job, edge_id, source, target, low, high, confidence."""
    same = F.count("*").over(Window.partitionBy("job", "camera_id"))
    c = cameras.withColumn("same", same).groupBy("job").agg(
        F.count("*").alias("cameras"), F.max(blank(F.col("camera_id")) | (F.octet_length("camera_id") > 80)).alias("bad_id"), F.max(F.col("same") > 1).alias("twice"),
        F.max(scheme_missing(F.col("uri"), "http", "https") | spaced(F.col("uri"))).alias("bad_uri"), F.max(F.abs("offset_ms") > 3_600_000).alias("bad_offset"),
    )
    known = cameras.select("job", F.col("camera_id").alias("known")).distinct()
    ends = edges.select("job", F.explode(F.array("source", "target")).alias("known")).join(known, ["job", "known"], "left_anti").select("job").distinct().withColumn("lost", F.lit(True))
    e = edges.withColumn("same", F.count("*").over(Window.partitionBy("job", "edge_id"))).groupBy("job").agg(
        F.max(blank(F.col("edge_id")) | (F.col("same") > 1)).alias("bad_edge"), F.max(F.col("source") == F.col("target")).alias("loop"), F.max(F.col("high") < F.col("low")).alias("window"), F.max(outside(F.col("confidence"), 0, 1)).alias("share"),
    )
    rows = jobs.join(c, "job", "left").join(e, "job", "left").join(ends, "job", "left")
    return rows.select("job", codes({
        "name": blank(F.col("name")) | (F.octet_length("name") > 120),
        "cameras": ~F.coalesce("cameras", F.lit(0)).between(2, most_cameras), "camera_id": F.col("bad_id"), "camera_twice": F.col("twice"), "camera_uri": F.col("bad_uri"), "clock_offset": F.col("bad_offset"),
        "edge_id": F.col("bad_edge"), "edge_loop": F.col("loop"), "edge_camera": F.col("lost"), "edge_window": F.col("window"), "edge_confidence": F.col("share"),
        "thresholds": outside(F.col("appearance"), 0, 1) | outside(F.col("provisional"), 0.55, 1) | ~F.col("final").between(F.col("provisional"), 1) | (F.col("tolerance_ms") <= 0),
    }).alias("violations"))


def memory_requests(jobs: DataFrame, cameras: DataFrame, most_cameras: int = 64) -> DataFrame:
    """job, violations. jobs: job, name, key, fps. cameras: job, camera_id, url, description, lat, lng."""
    folder = F.substring(F.regexp_replace("camera_id", "[^A-Za-z0-9_-]", "_"), 1, 80)
    times = lambda c: F.count("*").over(Window.partitionBy("job", c))
    c = cameras.withColumn("folder", folder).withColumns({"ids": times("camera_id"), "urls": times("url"), "folders": times("folder")}).groupBy("job").agg(
        F.count("*").alias("cameras"), F.max(F.col("folders") > 1).alias("folder"), F.max(blank(F.col("camera_id")) | (F.octet_length("camera_id") > 80) | (F.col("ids") > 1)).alias("id"),
        F.max(scheme_missing(F.col("url"), "http", "https", "rtsp", "rtsps") | spaced(F.col("url"))).alias("url"), F.max(F.col("urls") > 1).alias("url_twice"),
        F.max(F.octet_length("description") > 1000).alias("text"), F.max((F.col("lat").isNotNull() & outside(F.col("lat"), -90, 90)) | (F.col("lng").isNotNull() & outside(F.col("lng"), -180, 180))).alias("place"),
    )
    return jobs.join(c, "job", "left").select("job", codes({
        "idempotency_key": F.col("key").isNotNull() & ~F.col("key").rlike("^[A-Za-z0-9_-]{16,128}$"), "folder": F.col("folder"), "name": blank(F.col("name")) | (F.octet_length("name") > 120),
        "cameras": ~F.coalesce("cameras", F.lit(0)).between(1, most_cameras), "fps": outside(F.col("fps"), 0.1, 5.0), "camera_id": F.col("id"), "url": F.col("url"), "url_twice": F.col("url_twice"), "fields": F.col("text"), "coordinates": F.col("place"),
    }).alias("violations"))


def memory_query() -> Column:
    """Columns query, limit, start_ms, end_ms, sessions (array of strings)."""
    return codes({
        "sessions": (F.size("sessions") > 256) | F.exists("sessions", lambda s: (s == "") | (F.octet_length(s) > 128)),
        "query": blank(F.col("query")) | (F.octet_length("query") > 1000), "limit": outside(F.col("limit"), 1, 50), "times": F.col("end_ms") < F.col("start_ms"),
    })


def short_list(items: Column, most: int = 12, longest: int = 200) -> Column:
    """Whether a list has at most `most` entries, none blank and none of more than `longest` bytes."""
    return (F.size(items) <= most) & F.forall(items, lambda x: ~blank(x) & (F.octet_length(x) <= longest))


def scope(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(F.col(n).rlike("^[A-Za-z0-9_-]{1,128}$"), F.lit(False))
    return out


def interpretation(longest_answer: int = 6400) -> Column:
    """Columns status, answer, lo, hi, times (array), citations (array of struct index, t, visibility), images (array of
    strings, one for each time), gate_passed."""
    times, cited = F.col("times"), F.col("citations")
    at = lambda c: F.get(times, c["index"].cast("int"))
    visible = F.filter(cited, lambda c: c["visibility"] == "visible")
    shown = F.array_distinct(F.transform(cited, lambda c: F.get(F.col("images"), c["index"].cast("int"))))
    where = F.transform(cited, lambda c: c["index"].cast("int"))
    return codes({
        "status": ~F.col("status").isin("supported", "not_observed", "uncertain"),
        "answer": blank(F.col("answer")) | (F.octet_length("answer") > longest_answer),
        "times": ~F.size(times).between(2, 16) | (times != F.array_distinct(F.array_sort(times))) | F.exists(times, lambda t: (t < F.col("lo")) | (t >= F.col("hi"))),
        "citation": F.exists(cited, lambda c: ~F.coalesce(at(c) == c["t"], F.lit(False)) | ~c["visibility"].isin("visible", "absent", "unclear")) | (F.size(F.array_distinct(where)) < F.size(where)),
        "two_visible": (F.col("status") == "supported") & (F.size(visible) < 2),
        "gate": (F.col("status") == "supported") & ~F.coalesce("gate_passed", F.lit(False)),
        "repeated_image": (F.col("status") == "supported") & (F.size(shown) < 2),
        "absence": (F.col("status") == "not_observed") & ~(F.array_contains(where, 0) & F.array_contains(where, F.size(times) - 1) & F.forall(cited, lambda c: c["visibility"] == "absent") & (F.size(where) >= 2)),
    })


def search_results(items: DataFrame, allowed: DataFrame) -> DataFrame:
    """query, violations. items: query, mode, limit, event_id, score. allowed: query, event_id."""
    ok = allowed.select("query", "event_id").distinct().withColumn("ok", F.lit(True))
    rows = items.join(ok, ["query", "event_id"], "left").groupBy("query").agg(
        F.first("mode").alias("mode"), F.max("limit").alias("limit"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.max(F.col("ok").isNull()).alias("strange"), F.max(outside(F.col("score"), 0, 1)).alias("score"),
    )
    return rows.select("query", codes({"mode": ~F.col("mode").isin("hybrid_rrf", "hybrid_qwen_reranker"), "count": F.col("n") > F.col("limit"), "twice": F.col("ids") < F.col("n"), "not_allowed": F.col("strange"), "score": F.col("score")}).alias("violations"))


def graph_integrity(entities: DataFrame, points: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """rule, broken: how many rows break each rule of an entity graph. entities: entity, camera. points: point, entity,
    event_id, t. events: event_id, camera, start_ms, end_ms. links: from, to, entity, gap_ms."""
    e = events.select("event_id", F.col("camera").alias("event_camera"), "start_ms", "end_ms")
    placed = points.join(entities, "entity", "left").join(e, "event_id", "left")
    ends = points.select("point", "entity", "t")
    tied = links.join(ends.select(F.col("point").alias("from"), F.col("entity").alias("e1"), F.col("t").alias("t1")), "from", "left").join(ends.select(F.col("point").alias("to"), F.col("entity").alias("e2"), F.col("t").alias("t2")), "to", "left")
    count = lambda df, rule, bad: df.where(F.coalesce(bad, F.lit(False))).agg(F.count("*").alias("broken")).select(F.lit(rule).alias("rule"), "broken")
    out = count(entities.groupBy("entity").agg(F.count("*").alias("n")), "entity_twice", F.col("n") > 1)
    for part in (
        count(points.groupBy("point").agg(F.count("*").alias("n")), "point_twice", F.col("n") > 1),
        count(placed, "entity_missing", F.col("camera").isNull()),
        count(placed, "event_missing", F.col("start_ms").isNull()),
        count(placed, "camera", F.col("camera") != F.col("event_camera")),
        count(placed, "interval", (F.col("t") < F.col("start_ms")) | (F.col("t") >= F.col("end_ms"))),
        count(tied, "link_end_missing", F.col("t1").isNull() | F.col("t2").isNull()),
        count(tied, "link_entity", (F.col("e1") != F.col("entity")) | (F.col("e2") != F.col("entity"))),
        count(tied, "link_gap", (F.col("t2") < F.col("t1")) | (F.col("gap_ms") != F.col("t2") - F.col("t1"))),
    ):
        out = out.unionByName(part)
    return out


def reward_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with violations. Columns camera, contributor, overlap, quality (array of shares), pce, rho, zoning, uptime."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    id_ = lambda c: F.col(c).isNull() | ~F.octet_length(c).between(1, 128)
    return nodes.withColumn("same", F.count("*").over(Window.partitionBy("camera"))).withColumn("violations", codes({
        "identity": id_("camera") | id_("contributor"), "camera_twice": F.col("same") > 1, "overlap": F.col("overlap") <= 0,
        "quality": F.exists("quality", lambda v: outside(v, 0, 1)), "measurement": ~finite(F.col("pce")) | outside(F.col("rho"), -1, 1) | outside(F.col("zoning"), 0.5, 3) | outside(F.col("uptime"), 0, 36500),
    })).drop("same")


def capture_sessions(sessions: DataFrame, gap_ms: int = 1000, most: int = 256) -> DataFrame:
    """camera, violations: whether a camera's sessions cover its frames without holes, in order and truly apart. sessions:
    camera, nth (from 0), first_frame, last_frame, first_ms, last_ms, frames (of the camera)."""
    order = Window.partitionBy("camera").orderBy("nth")
    rows = sessions.withColumns({"before_frame": F.lag("last_frame").over(order), "before_ms": F.lag("last_ms").over(order), "final": F.lead("nth").over(order).isNull()})
    some = lambda c: F.max(F.coalesce(c, F.lit(False)))
    per = rows.groupBy("camera").agg(
        F.count("*").alias("n"), some(F.col("first_frame") != F.coalesce(F.col("before_frame") + 1, F.lit(0))).alias("hole"), some((F.col("last_frame") < F.col("first_frame")) | (F.col("last_ms") < F.col("first_ms"))).alias("order"),
        some(F.col("first_ms") - F.col("before_ms") <= gap_ms).alias("gap"), some(F.col("before_ms").isNull() & (F.col("first_ms") != 0)).alias("origin"), some(F.col("final") & (F.col("last_frame") + 1 != F.col("frames"))).alias("end"),
    )
    return per.select("camera", codes({"number": F.col("n") > most, "hole": F.col("hole"), "order": F.col("order"), "spacing": F.col("gap"), "origin": F.col("origin"), "coverage": F.col("end")}).alias("violations"))


def checkpoints(sets: DataFrame, events: DataFrame) -> DataFrame:
    """job, camera, violations of a camera's stored parts. sets: job, camera, storage, session. events: job, camera,
    session, event_id, event_job, event_camera."""
    per = sets.groupBy("job", "camera").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("session", F.lit(""))).alias("sessions"), F.count("storage").alias("stored"), F.countDistinct("storage").alias("storages"))
    e = events.withColumn("same", F.count("*").over(Window.partitionBy("job", "camera", "event_id"))).groupBy("job", "camera").agg(F.max(F.col("same") > 1).alias("twice"), F.max((F.col("event_job") != F.col("job")) | (F.col("event_camera") != F.col("camera"))).alias("scope"))
    return per.join(e, ["job", "camera"], "left").select("job", "camera", codes({"number": F.col("n") > 256, "session_twice": F.col("sessions") < F.col("n"), "storage": (F.col("storages") < F.col("stored")) | ((F.col("n") > 1) & (F.col("stored") < F.col("n"))), "event_twice": F.col("twice"), "event_scope": F.col("scope")}).alias("violations"))


def face_frames(frames: DataFrame) -> DataFrame:
    """scope, t, violations. frames: scope, t, seq (of arrival), boxes (array of struct x, y, w, h, conf)."""
    bad = lambda b: ~((b["x"] >= 0) & (b["y"] >= 0) & (b["w"] > 0) & (b["h"] > 0) & (b["x"] + b["w"] <= 1) & (b["y"] + b["h"] <= 1) & b["conf"].between(0, 1)) | F.isnan(b["x"] + b["y"] + b["w"] + b["h"] + b["conf"])
    before = F.lag("t").over(Window.partitionBy("scope").orderBy("seq"))
    return frames.withColumn("before", before).select("scope", "t", "seq", codes({"number": F.size("boxes") > 10_000, "box": F.exists("boxes", bad), "time": F.col("t") <= F.col("before")}).alias("violations"))


def track_citations() -> Column:
    """status after the guards of a selected track. Columns status, crops (array of struct t, x, y, w, h; null where a
    cited frame has none), same_pixels (whether the crops show no change): a claim needs two aligned crops at different
    times that differ in box or picture; a track never proves absence."""
    crops = F.col("crops")
    first = F.get(crops, F.lit(0))
    moved = F.exists(crops, lambda c: F.greatest(*[F.abs(c[k] - first[k]) for k in "xywh"]) >= 0.002)
    unaligned = F.exists(crops, lambda c: c.isNull()) | (F.size(F.array_distinct(F.transform(crops, lambda c: c["t"]))) < 2)
    doubt = F.when(F.col("status") == "supported", unaligned | (~moved & F.col("same_pixels"))).otherwise(F.col("status") == "not_observed")
    return F.when(crops.isNotNull() & doubt, "uncertain").otherwise(F.col("status"))


def static_citations() -> Column:
    """status, where a claim whose cited pictures don't differ becomes uncertain. Columns status, mean_difference."""
    return F.when((F.col("status") == "supported") & (F.col("mean_difference") <= 0.5), "uncertain").otherwise(F.col("status"))


def review_packets(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """case, violations: the review of each case of a packet. cases: case, n_frames, sha. reviews: case, reviewer,
    identity, reference_visible, object, n_frames, sha, states (array)."""
    r = reviews.select("case", F.lit(True).alias("there"), "reviewer", "identity", "reference_visible", "object", F.col("n_frames").alias("reviewed"), F.col("sha").alias("seen"), "states")
    have = F.col("there").isNotNull()
    return cases.join(r, "case", "left").select("case", codes({
        "missing": ~have, "reviewer": have & blank(F.col("reviewer")), "identity": have & ~F.coalesce(F.col("identity").isin("same", "different", "unclear"), F.lit(False)), "reference": have & F.col("reference_visible").isNull(), "object": have & blank(F.col("object")),
        "frames": have & (F.col("reviewed") != F.col("n_frames")), "hash": have & (F.col("seen") != F.col("sha")), "state": F.exists("states", lambda s: ~s.isin("far", "middle", "near", "unclear")),
    }).alias("violations"))


def reviewed_score(expected: Column) -> tuple[Column, Column]:
    """category, passed. Columns status, identity, reference_visible, n_visible, cited_visible (how many of two), claimed;
    expected is the transition between the cited states."""
    uncertain = F.col("status") == "uncertain"
    cases = [
        (F.col("identity") != "same", "mixed_or_unclear_identity_history", uncertain),
        (~F.col("reference_visible"), "reference_unresolved", uncertain),
        (F.col("n_visible") < 2, "insufficient_reviewed_target_visibility", uncertain),
        (F.col("status") != "supported", "abstained_without_action_comparison", F.lit(None).cast("boolean")),
        (F.col("cited_visible") != 2, "unsupported_visibility", F.lit(False)),
        (F.lit(True), "cited_target_states", F.coalesce(expected == F.col("claimed"), F.lit(False))),
    ]
    category, passed = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for when, name, ok in cases[1:]:
        category, passed = category.when(when, name), passed.when(when, ok)
    return category, passed


def experiment_results(results: DataFrame, scope_: DataFrame, profile: str) -> DataFrame:
    """case, violations. results: case, profile, event_id. scope_: case, event_id."""
    ok = scope_.select("case", "event_id").distinct().withColumn("ok", F.lit(True))
    per = results.join(ok, ["case", "event_id"], "left").groupBy("case").agg(F.max(F.col("profile") != profile).alias("profile"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.max(F.col("ok").isNull()).alias("strange"))
    return per.select("case", codes({"profile": F.col("profile"), "twice": F.col("ids") < F.col("n"), "not_in_scope": F.col("strange")}).alias("violations"))


def sources(requests: DataFrame, manifest: DataFrame, revoked: DataFrame, root: str) -> DataFrame:
    """request, violations: may a piece of a source be read? requests: request, path, start_ms, end_ms, sha. manifest:
    path, sha. revoked: path."""
    known = manifest.select("path", F.col("sha").alias("committed"))
    gone = revoked.select("path").distinct().withColumn("gone", F.lit(True))
    rows = requests.join(known, "path", "left").join(gone, "path", "left")
    inside = F.startswith("path", F.lit(root.rstrip("/") + "/")) & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return rows.select("request", codes({"root": ~inside, "revoked": F.col("gone"), "interval": F.col("start_ms") >= F.col("end_ms"), "missing": F.col("committed").isNull(), "hash": F.col("committed") != F.col("sha")}).alias("violations"))
