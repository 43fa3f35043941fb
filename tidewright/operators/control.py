"""The control plane as operations on tables: submissions, job states, queues, revocations, projections, deployments.

Each takes the whole log or state as frames and returns the state that follows; nothing is kept between calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import URL, uuid5
from .validation import blank, codes


def profile_fingerprint(version: Column, components: Column) -> Column:
    """SHA-256 of a profile's version and its components (a map) in order of their names."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(components)))
    return F.sha2(F.concat(F.lit("["), F.to_json(F.struct(version.alias("v"))).substr(F.lit(6), F.length(version) + 2), F.lit(","), F.to_json(entries), F.lit("]")), 256)


def artifact_key(sha: Column, start: Column, end: Column, version: Column) -> Column:
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", quoted(sha), start.cast("string"), end.cast("string"), quoted(version)), F.lit("]")), 256)


def request_fingerprint(policy: Column, request: list[str], profile: Column | None = None) -> Column:
    """SHA-256 of the policy and the request's fields, without its key; and of the profile, where there is one."""
    body = F.concat(F.lit("["), F.concat(F.lit('"'), policy, F.lit('"')), F.lit(","), F.to_json(F.struct(*request)), F.lit("]"))
    return F.sha2(body if profile is None else F.concat(body, F.lit("|"), profile), 256)


def index_job_id(items: DataFrame, scope: str, policy: str, version: str) -> DataFrame:
    """job, job_id, items: the content-derived id of each index job. items: job, event_id, sha, start_ms, end_ms."""
    item = F.concat_ws("|", "event_id", "sha", F.col("start_ms").cast("string"), F.col("end_ms").cast("string"))
    contract = F.concat_ws("\n", F.lit(scope), F.lit(policy), F.lit(version), F.array_join(F.array_sort(F.collect_list(item)), "\n"))
    return items.groupBy("job").agg(uuid5(URL, F.sha2(contract, 256)).alias("job_id"), F.count("*").alias("items"))


def submitted(requests: DataFrame, capacity: int = 8) -> DataFrame:
    """requests with outcome: invalid, created, existing, conflict (the key came first with another fingerprint) or full
    (the queue has `capacity` open jobs). requests: queue, seq, key (null: none), fingerprint, violations."""
    sound = F.col("violations") == ""
    first = Window.partitionBy("queue", F.coalesce("key", F.concat(F.lit("\u0000"), F.col("seq").cast("string"))), sound).orderBy("seq")
    rows = requests.withColumns({"first": F.first("fingerprint").over(first), "nth": F.row_number().over(first)})
    new = sound & (F.col("nth") == 1)
    place = F.sum(new.cast("int")).over(Window.partitionBy("queue").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(~sound, "invalid").when(F.col("first") != F.col("fingerprint"), "conflict").when(F.col("nth") > 1, "existing").when(place > capacity, "full").otherwise("created")
    return rows.withColumn("outcome", outcome).drop("first", "nth")


#: What an action does to a job in a state; others are refused.
MOVES = {("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "finish"): "completed", ("running", "fail"): "failed", ("running", "cancel"): "cancelled", ("cancelled", "resume"): "queued", ("failed", "resume"): "queued"}


def job_states(actions: DataFrame) -> DataFrame:
    """job, state, refused: each job's state after its actions (job, seq, action), from queued on."""
    rule = F.create_map(*[x for (s, a), n in MOVES.items() for x in (F.lit(f"{s}/{a}"), F.lit(n))])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "action"))), lambda x: x["action"])
    start = F.struct(F.lit("queued").alias("state"), F.lit(0).alias("refused"))

    def step(s, action):
        new = F.try_element_at(rule, F.concat(s["state"], F.lit("/"), action))
        return F.struct(F.coalesce(new, s["state"]).alias("state"), (s["refused"] + F.when(new.isNull(), 1).otherwise(0)).alias("refused"))

    return actions.groupBy("job").agg(ordered.alias("all")).select("job", F.aggregate("all", start, step).alias("s")).select("job", "s.*")


def pruned(jobs: DataFrame, limit: int) -> DataFrame:
    """The jobs left of each owner, where more than `limit` are kept only if they aren't finished: the oldest finished ones
    go. jobs: owner, job, created, state."""
    done = F.col("state").isin("completed", "failed")
    rows = jobs.withColumns({"n": F.count("*").over(Window.partitionBy("owner")), "old": F.row_number().over(Window.partitionBy("owner", done).orderBy("created", "job"))})
    return rows.where(~done | (F.col("old") > F.col("n") - limit)).drop("n", "old")


def cluster_totals(cameras: DataFrame) -> DataFrame:
    """job, state, succeeded, failed, tracks, events, duration_ms over cameras (job, camera, error, tracks, events,
    duration_ms): a job fails only if all its cameras do."""
    ok = F.col("error").isNull()
    part = lambda c, f: f(F.when(ok, F.col(c)))
    rows = cameras.groupBy("job").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.coalesce(part("tracks", F.sum), F.lit(0)).alias("tracks"), F.coalesce(part("events", F.sum), F.lit(0)).alias("events"), part("duration_ms", F.max).alias("duration_ms"))
    return rows.withColumn("state", F.when(F.col("succeeded") > 0, "completed").otherwise("failed"))


def surviving_artifacts(artifacts: DataFrame, sources: DataFrame, revoked: DataFrame) -> DataFrame:
    """The artifacts (kind, key) that a source which isn't revoked still backs; untracked ones go. sources: kind, key, path."""
    return artifacts.join(sources.join(revoked.select("path").distinct(), "path", "left_anti"), ["kind", "key"], "left_semi")


def readable(rows: DataFrame, revocations: DataFrame, key: str) -> DataFrame:
    """What a reader may see: rows whose key isn't revoked."""
    return rows.join(revocations.select(key).distinct(), key, "left_anti")


def witnessed(log: DataFrame) -> DataFrame:
    """scope, revision, digest, conflict: the latest entry of each scope in an append-only log (scope, revision, digest);
    a revision that was written with two digests is a conflict of its scope."""
    each = log.groupBy("scope", "revision").agg(F.min("digest").alias("digest"), F.countDistinct("digest").alias("n"))
    return each.groupBy("scope").agg(F.max(F.struct("revision", "digest")).alias("e"), F.max(F.col("n") > 1).alias("conflict")).select("scope", "e.*", "conflict")


def dispatches(targets: DataFrame, receipts: DataFrame, now: int, base_ms: int = 2000, most_ms: int = 300_000) -> DataFrame:
    """targets with state: done (a receipt of its revision), due or waiting (by doubling pauses). targets: scope, target,
    revision, attempts, tried_at. receipts: scope, target, revision."""
    got = receipts.groupBy("scope", "target").agg(F.max("revision").alias("got"))
    pause = F.least(F.lit(base_ms) * F.pow(F.lit(2), F.least("attempts", F.lit(20))), F.lit(most_ms))
    rows = targets.join(got, ["scope", "target"], "left")
    state = F.when(F.col("got") == F.col("revision"), "done").when(F.col("got") > F.col("revision"), "conflict").when((F.col("attempts") == 0) | (F.col("tried_at") + pause <= now), "due").otherwise("waiting")
    return rows.withColumn("state", state).drop("got")


def verified(expected: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """key, state: match, changed or missing, by fingerprints; a stored row that nothing expects is stray."""
    a, b = expected.select(key, F.col("fingerprint").alias("want")), stored.select(key, F.col("fingerprint").alias("have"))
    state = F.when(F.col("want").isNull(), "stray").when(F.col("have").isNull(), "missing").when(F.col("want") == F.col("have"), "match").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def replays(projections: DataFrame, now: int, most: int = 2) -> DataFrame:
    """The projections to be built next: not ready, due, the longest due first."""
    return projections.where((F.col("state") != "match") & (F.col("due_at") <= now)).orderBy("due_at", "key").limit(most)


def admitted(requests: DataFrame, burst: int = 4, waiting: int = 8) -> DataFrame:
    """gate, seq, place: the order in which a gate lets requests in. Interactive ones go first, but after each `burst` of them
    one in the background goes; of each kind no more than `waiting` wait, the others get no place."""
    kind = Window.partitionBy("gate", "interactive").orderBy("seq")
    rows = requests.withColumn("nth", F.row_number().over(kind) - 1)
    turn = F.when(F.col("interactive"), F.floor(F.col("nth") / burst)).otherwise(F.col("nth"))
    rows = rows.withColumns({"turn": turn, "in": F.col("nth") < waiting})
    place = F.row_number().over(Window.partitionBy("gate", "in").orderBy("turn", F.desc("interactive"), "nth"))
    return rows.select("gate", "seq", F.when(F.col("in"), place).alias("place"))


def queue_steps(items: DataFrame, most_attempts: int = 2) -> DataFrame:
    """The item that each queue runs next: the longest unchanged one that is queued, or failed for a passing reason with
    attempts left. items: queue, item, state, attempts, permanent, updated."""
    open_ = (F.col("state") == "queued") | ((F.col("state") == "failed") & ~F.col("permanent") & (F.col("attempts") < most_attempts))
    return items.where(open_).groupBy("queue").agg(F.min(F.struct("updated", "item")).alias("next")).select("queue", F.col("next.item").alias("item"))


def index_jobs(items: DataFrame, errors: int = 10) -> DataFrame:
    """job, counts by state, state and the first errors. items: job, item, state, error, artifact_ok (still there and sound)."""
    done = (F.col("state") == "done") & F.col("artifact_ok")
    listed = F.slice(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("item", "error")))), 1, errors)
    rows = items.groupBy("job").agg(F.count("*").alias("items"), F.count_if(done).alias("done"), *[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "running", "failed")], F.array_join(F.transform(listed, lambda x: x["error"]), ";").alias("errors"))
    return rows.withColumn("state", F.when(F.col("failed") > 0, "failed").when(F.col("done") == F.col("items"), "completed").when(F.col("running") > 0, "running").otherwise("queued"))


def deployments(log: DataFrame) -> DataFrame:
    """name, generation, violations. log: name, generation, fingerprint, receipt, active: generations follow each other from 1,
    fingerprints are SHA-256 and new, an active one has a receipt and there is one of them."""
    order = Window.partitionBy("name").orderBy("generation")
    rows = log.withColumns({"before": F.coalesce(F.lag("generation").over(order), F.lit(0)), "same": F.count("*").over(Window.partitionBy("name", "fingerprint")), "live": F.sum(F.col("active").cast("int")).over(Window.partitionBy("name"))})
    return rows.select("name", "generation", codes({"generation": F.col("generation") != F.col("before") + 1, "fingerprint": ~F.col("fingerprint").rlike("^[0-9a-f]{64}$"), "repeated": F.col("same") > 1, "receipt": F.col("active") & blank(F.col("receipt")), "active": F.col("live") > 1}).alias("violations"))


def storage_contracts(stores: DataFrame, versions: tuple[int, ...] = (1, 2), features: tuple[str, ...] = ("wal", "fence")) -> DataFrame:
    """store, violations. stores: store, version, features (array), fenced."""
    return stores.select("store", codes({"version": ~F.col("version").isin(*versions), "feature": F.size(F.array_except(F.array(*map(F.lit, features)), F.col("features"))) > 0, "fenced": F.col("fenced")}).alias("violations"))


def compared(left: DataFrame, right: DataFrame, ignored: tuple[str, ...] = ("elapsed",)) -> DataFrame:
    """case, repeat, exact, ranking, metric, missing: two arms of an experiment, paired by case and repeat. Columns case,
    repeat, ranking (array), metric, and others that count for exactness unless ignored."""
    keys = ["case", "repeat"]
    fields = [c for c in left.columns if c not in (*keys, *ignored)]
    pack = lambda df, name: df.select(*keys, F.struct(*fields).alias(name))
    rows = pack(left, "a").join(pack(right, "b"), keys, "full")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    every = F.lit(True)
    for c in fields:
        every = every & same(c)
    there = F.col("a").isNotNull() & F.col("b").isNotNull()
    return rows.select(*keys, (there & every).alias("exact"), (there & same("ranking")).alias("ranking"), (there & same("metric")).alias("metric"), (~there).alias("missing"))


def evaluation(results: DataFrame, queries: DataFrame) -> DataFrame:
    """mode, attempted, failed, mean, empty_rate, latency: failures stay in the denominators. results: mode, query, metric
    (null: failed), returned, latency. queries: query, positive."""
    n = queries.agg(F.count_if("positive").alias("np"), F.count_if(~F.col("positive")).alias("nn"))
    rows = results.join(queries, "query").groupBy("mode").agg(
        F.count("*").alias("attempted"), F.count_if(F.col("metric").isNull()).alias("failed"), F.sum(F.when(F.col("positive"), F.coalesce("metric", F.lit(0.0)))).alias("s"), F.count_if(~F.col("positive") & F.col("metric").isNotNull() & (F.col("returned") == 0)).alias("e"), F.avg("latency").alias("latency"),
    )
    return rows.join(F.broadcast(n), F.lit(True)).select("mode", "attempted", "failed", F.round(F.col("s") / F.col("np"), 6).alias("mean"), F.round(F.col("e") / F.col("nn"), 6).alias("empty_rate"), F.round("latency", 6).alias("latency"))


def payloads(events: DataFrame, entities: DataFrame) -> DataFrame:
    """camera, session, events (JSON of its intervals in order), entities, violations. events: camera, session, event_id,
    start_ms, end_ms, duration_ms. entities: camera, session, entity_id."""
    item = F.struct("start_ms", "event_id", "end_ms")
    per = events.groupBy("camera", "session").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("events"), F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.max((F.col("start_ms") >= F.col("end_ms")) | (F.col("end_ms") > F.col("duration_ms"))).alias("bad"))
    own = entities.groupBy("camera", "session").agg(F.countDistinct("entity_id").alias("entities"))
    rows = per.join(own, (per.camera == own.camera) & per.session.eqNullSafe(own.session), "left").select(per.camera, per.session, "events", F.coalesce("entities", F.lit(0)).alias("entities"), "n", "ids", "bad")
    return rows.select("camera", "session", "events", "entities", codes({"twice": F.col("ids") < F.col("n"), "interval": F.col("bad")}).alias("violations"))


def aligned(frames: DataFrame, boxes: DataFrame, keys: list[str], tolerance: int = 1) -> DataFrame:
    """frames with box, where exactly one time of the boxes lies within the tolerance; null otherwise. Two boxes at one time
    are an error. frames: keys, t; boxes: keys, t, box."""
    one = boxes.groupBy(*keys, "t").agg(F.min("box").alias("box"), F.countDistinct("box").alias("n"))
    one = one.select(*keys, "t", F.when(F.col("n") > 1, F.raise_error(F.lit("boxes at one time differ"))).otherwise(F.col("box")).alias("box"))
    near = one.withColumn("at", F.explode(F.sequence(F.col("t") - tolerance, F.col("t") + tolerance))).select(*keys, F.col("at").alias("t"), "box")
    found = near.groupBy(*keys, "t").agg(F.count("*").alias("n"), F.first("box").alias("b")).where("n = 1").select(*keys, "t", F.col("b").alias("box"))
    return frames.join(found, [*keys, "t"], "left")
