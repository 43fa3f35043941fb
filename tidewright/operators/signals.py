"""Signals of a source: motion vectors, tracker routing, liveness, capture continuity, clear windows of a track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def motion_class(mx: Column, my: Column, given: Column | None = None, noise: float = 2.0, edge: float = 50.0) -> Column:
    """The kind of a motion vector; one that is given wins."""
    size = F.sqrt(mx * mx + my * my)
    own = F.when(size <= noise, "noise").when(size > edge, "edge").when((F.abs(mx) > 1.5) | (F.abs(my) > 1.5), "foreground").otherwise("background")
    return own if given is None else F.coalesce(given, own)


def gating(vectors: DataFrame, keys: list[str], blocks: float = 100.0, ratio: float = 0.035, entropy: float = 0.25, rate: float = 1200.0, weight: float = 100.0) -> DataFrame:
    """For each frame: foreground blocks and their share, entropy of the moving vectors' eight bins of size, extent of the
    foreground vectors (null under four moving ones), whether to decode, and the loss. vectors: keys, mx, my, x, y, w, h,
    intra (a block coded anew)."""
    size = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my"))
    kind = motion_class(F.col("mx"), F.col("my"))
    rows = vectors.withColumns({"size": size, "fg": kind == "foreground", "bin": F.when(size > 2, F.least(F.floor(size / 5), F.lit(7)))})
    bins = [F.count_if(F.col("bin") == k).alias(f"b{k}") for k in range(8)]
    edge = lambda f, c: f(F.when(F.col("fg"), c))
    per = rows.groupBy(*keys).agg(F.count_if(F.col("intra") | F.col("fg")).alias("foreground"), F.count_if("fg").alias("moving"), *bins, edge(F.min, F.col("x")).alias("x0"), edge(F.min, F.col("y")).alias("y0"), edge(F.max, F.col("x") + F.col("w")).alias("x1"), edge(F.max, F.col("y") + F.col("h")).alias("y1"))
    total = sum((F.col(f"b{k}") for k in range(1, 8)), F.col("b0"))
    part = lambda k: F.when(F.col(f"b{k}") > 0, -(F.col(f"b{k}") / total) * F.log2(F.col(f"b{k}") / total)).otherwise(0.0)
    h = F.when(total > 0, F.least(F.lit(1.0), sum((part(k) for k in range(1, 8)), part(0)) / 3)).otherwise(0.0)
    share = F.least(F.col("foreground") / blocks, F.lit(1.0))
    rows = per.withColumns({"ratio": share, "entropy": h})
    decode = (F.col("ratio") >= ratio) | ((F.col("entropy") >= entropy) & (F.col("moving") > 8))
    loss = rate + weight * F.when(F.col("ratio") > ratio, 1 - F.col("ratio")).otherwise(0.05)
    box = F.when(F.col("moving") >= 4, F.array("x0", "y0", "x1", "y1"))
    return rows.select(*keys, "foreground", F.round("ratio", 6).alias("ratio"), F.round("entropy", 6).alias("entropy"), decode.alias("decode"), F.round(loss, 6).alias("loss"), box.alias("extent"))


def routing(boxes: Column, shake: Column, downsample: Column, handover: int = 25, most_shake: float = 4.5) -> Column:
    """struct tracker, regime, points of a frame's boxes (array of struct x, y, w, h): dense frames are handed over to points,
    about where heads are; then come downsampled, shaking and other frames."""
    n = F.size(boxes)
    dense = (n >= 35) | (n >= handover)
    regime = F.when(dense, "ultra_dense_handover").when(n >= 20, "dense").otherwise("sparse_to_moderate")
    tracker = F.when(dense, "point_localization").when(downsample >= 6, "sr_track").when(shake >= most_shake, "bot_sort").otherwise("byte_track")
    points = F.when(dense, F.transform(boxes, lambda b: F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] * 0.25).alias("y"))))
    return F.struct(tracker.alias("tracker"), regime.alias("regime"), points.alias("points"))


def peak_energy(matrix: Column, width: int, height: int, radius: int = 2) -> Column:
    """The squared peak of a matrix (an array, row by row) by the mean square outside the square around it; -0.10 for
    a matrix of another size, with values that aren't finite, or without energy there. The first peak counts."""
    bad = F.exists(matrix, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    at = F.array_position(matrix, F.array_max(matrix)) - 1
    far = lambda i: (F.abs(F.floor(i / width) - F.floor(at / width)) > radius) | (F.abs(i % width - at % width) > radius)
    rest = F.filter(matrix, lambda v, i: far(i))
    energy = F.aggregate(rest, F.lit(0.0), lambda s, v: s + v * v)
    sound = (F.size(matrix) == width * height) & ~bad
    return F.when(~sound | (energy <= 1e-9), -0.10).otherwise(F.pow(F.array_max(matrix), F.lit(2)) / (energy / F.size(rest)))


def liveness(rows: DataFrame, calibration: int = 200, least_pce: float = 60.0, least_rho: float = 0.85, nominal: float = 50.0) -> DataFrame:
    """source, status, rho. rows: source, frames, pce, trace and reference (arrays of equal length). Signals that match don't
    prove that a stream is authentic, so none ever counts as that."""
    trace, ref = F.col("trace"), F.col("reference")
    sound = lambda a: F.size(a).between(4, 100_000) & F.forall(a, lambda v: ~F.isnan(v) & (F.abs(v - nominal) <= 2))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    rows = rows.withColumns({"mt": mean(trace), "mr": mean(ref)})
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    d, e = F.transform(trace, lambda v: v - F.col("mt")), F.transform(ref, lambda v: v - F.col("mr"))
    den = F.sqrt(total(d, d) * total(e, e))
    rho = F.when(den <= 1e-9, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total(d, e) / den)))
    valid = ~F.isnan("pce") & (F.size(trace) == F.size(ref)) & sound(trace) & sound(ref)
    rows = rows.withColumns({"valid": F.coalesce(valid, F.lit(False)), "rho": rho})
    ok = F.col("pce") >= least_pce, F.col("rho") >= least_rho
    status = F.when(F.col("frames") < calibration, "calibrating").when(~F.col("valid"), "invalid_signals").when(ok[0] & ok[1], "unverified_signals").when(~ok[0] & ~ok[1], "signals_below_threshold").when(~ok[0], "sensor_signal_mismatch").otherwise("enf_signal_mismatch")
    known = F.col("valid") & (F.col("frames") >= calibration)
    return rows.select("source", status.alias("status"), F.when(known, F.round("rho", 6)).otherwise(0.0).alias("rho"), F.lit(False).alias("is_authentic"))


def continuity(rows: DataFrame, key: str, gap_ms: int = 1000, most: int = 256) -> DataFrame:
    """rows (key, seq of arrival, t, track_id, reconnect) with epoch and session_track: a new epoch begins after a gap or a
    reconnect, and its trackers start anew, so their ids say which one; limited tells sources with more than `most`
    epochs. A time that runs backwards is an error."""
    order = Window.partitionBy(key).orderBy("seq")
    gap = F.col("t") - F.lag("t").over(order)
    checked = F.when(gap < 0, F.raise_error(F.lit("time runs backwards")).cast("bigint")).otherwise(gap)
    cut = F.when((checked > gap_ms) | (F.col("reconnect") & F.lag("t").over(order).isNotNull()), 1).otherwise(0)
    out = rows.withColumn("cut", cut).withColumn("epoch", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("cut")
    name = F.when(F.col("epoch") > 0, F.concat(F.lit("session-"), F.col("epoch").cast("string"), F.lit(":"), "track_id")).otherwise(F.col("track_id"))
    return out.withColumns({"session_track": name, "limited": F.max("epoch").over(Window.partitionBy(key)) >= most})


def sessions(rows: DataFrame, key: str, gap_ms: int = 1000, most: int = 256) -> DataFrame:
    """key, epoch, first_ms, last_ms, frames, limited of each capture session."""
    return continuity(rows, key, gap_ms, most).groupBy(key, "epoch").agg(F.min("t").alias("first_ms"), F.max("t").alias("last_ms"), F.count("*").alias("frames"), F.first("limited").alias("limited"))


def clear_windows(boxes: DataFrame, keys: list[str], size: tuple[int, int], span_ms: int = 20_000, least_span: int = 1000, least_edge: float = 48.0, least_ratio: float = 1.25) -> DataFrame:
    """keys, t, min_edge, ratio, n: each track's best window of boxes, by its least edge, change of area and number. boxes:
    keys, t, seq, x, y, w, h; of boxes at one time the last counts."""
    last = boxes.groupBy(*keys, "t").agg(F.max_by(F.struct("x", "y", "w", "h"), "seq").alias("b")).select(*keys, "t", "b.*")
    inside = (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") + F.col("w") <= 1.001) & (F.col("y") + F.col("h") <= 1.001)
    rows = last.where(inside).withColumns({"edge": F.least(F.col("w") * size[0], F.col("h") * size[1]), "area": F.col("w") * F.col("h")}).where(F.col("edge") >= least_edge)
    ahead = Window.partitionBy(*keys).orderBy("t").rangeBetween(0, span_ms - 1)
    rows = rows.withColumns({"min_edge": F.min("edge").over(ahead), "ratio": F.max("area").over(ahead) / F.min("area").over(ahead), "n": F.count("*").over(ahead), "span": F.max("t").over(ahead) - F.col("t")})
    rows = rows.where((F.col("n") >= 2) & (F.col("span") >= least_span) & (F.col("ratio") >= least_ratio))
    best = F.max_by(F.struct("t", "min_edge", "ratio", "n"), F.struct("min_edge", "ratio", "n", -F.col("t"))).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, "b.*")


def exclusive_times(spans: DataFrame) -> DataFrame:
    """span, inclusive_ms, exclusive_ms (without its children). spans: span, parent, start_ms, end_ms."""
    took = F.col("end_ms") - F.col("start_ms")
    children = spans.groupBy(F.col("parent").alias("span")).agg(F.sum(took).alias("inner"))
    return spans.join(children, "span", "left").select("span", took.alias("inclusive_ms"), (took - F.coalesce("inner", F.lit(0))).alias("exclusive_ms"))


def metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """query, returned, and for queries with relevant items hit, recall and ndcg at each k (null for the others). ranked:
    query, rank, item; relevant: query, item. An item that is ranked twice is an error."""
    good = relevant.select("query", "item").distinct().withColumn("good", F.lit(1))
    n = good.groupBy("query").agg(F.count("*").alias("n"))
    rows = ranked.withColumn("same", F.count("*").over(Window.partitionBy("query", "item"))).withColumn("rank", F.when(F.col("same") > 1, F.raise_error(F.lit("an item is ranked twice")).cast("bigint")).otherwise(F.col("rank")))
    rows = rows.join(good, ["query", "item"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    at = lambda k, v: F.sum(F.when((F.col("rank") <= k), v).otherwise(0))
    per = rows.groupBy("query").agg(F.count("*").alias("returned"), *[x for k in ks for x in (at(k, F.col("good")).alias(f"h{k}"), at(k, F.col("good") / F.log2(F.col("rank") + 1)).alias(f"d{k}"))]).join(n, "query", "left")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    cols = [x for k in ks for x in (F.when(F.col("n") > 0, (F.col(f"h{k}") > 0).cast("int")).alias(f"hit_at_{k}"), F.round(F.col(f"h{k}") / F.col("n"), 6).alias(f"recall_at_{k}"), F.when(F.col("n") > 0, F.round(F.col(f"d{k}") / ideal(k), 6)).alias(f"ndcg_at_{k}"))]
    return per.select("query", "returned", *cols)


#: Words that a question's entities and kind are read from, as parts of words.
ENTITIES = {"vehicle": ["car", "vehicle", "truck", "van"], "pedestrian": ["person", "pedestrian", "crowd"], "barrier": ["barrier", "box", "package"]}
KINDS = {"causal_investigation": ["before", "after", "why", "preceded"], "footfall_aggregation": ["count", "how many", "footfall"]}


def decoupled(query: Column) -> tuple[Column, Column]:
    """entities and kind of a question."""
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(query), w))
    entities = F.array_compact(F.array(*[F.when(has(w), F.lit(e)) for e, w in ENTITIES.items()]))
    kind = F.lit("visual_semantic_search")
    for name, words in reversed(KINDS.items()):
        kind = F.when(has(words), name).otherwise(kind)
    return entities, kind


def report(obs: DataFrame, tracks: DataFrame, events: DataFrame, notable: int = 8, described: int = 6) -> DataFrame:
    """One row: headline, summary, ids and descriptions of the first events by time and track."""
    classes = tracks.groupBy("class_name").agg(F.count("*").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_name", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["class_name"])), ", ").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"))
    first = events.orderBy("t", "track_id", "emit_ordinal").limit(notable).select(F.struct("t", "track_id", "emit_ordinal", "event_id", "description").alias("e"))
    listed = first.agg(F.array_sort(F.collect_list("e")).alias("e")).select(F.array_join(F.transform("e", lambda x: x["event_id"]), ",").alias("ids"), F.array_join(F.transform(F.slice("e", 1, described), lambda x: x["description"]), "; ").alias("observations"))
    seen = obs.agg(F.count("*").alias("n"), (F.coalesce(F.max("t") - F.min("t"), F.lit(0)) / 1000).alias("seconds"))
    total = events.agg(F.count("*").alias("found"))
    rows = seen.join(classes, F.lit(True)).join(total, F.lit(True)).join(listed, F.lit(True))
    # Java's %.1f rounds the shortest decimal half up, 2.15 to 2.2; format_number rounds the double itself, to 2.1, as C does.
    seconds = F.call_function("format_number", F.col("seconds"), F.lit("0.0"))
    text = F.format_string("Processed %d observations across %d confirmed tracks (%s) over %s seconds and produced %d events.", "n", "tracks", F.when(F.col("classes") == "", "no confirmed tracks").otherwise(F.col("classes")), seconds, "found")
    headline = F.when(F.col("found") == 0, "No rule events observed").otherwise(F.concat(F.col("found").cast("string"), F.lit(" deterministic events observed")))
    return rows.select(headline.alias("headline"), text.alias("summary"), "ids", "observations")
