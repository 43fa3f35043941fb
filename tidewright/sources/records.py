"""Reading and writing of records: JSON observations, framed detector lines, files with hashes, envelopes, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OBSERVATION = "track_id string, class_name string, t bigint, seq bigint, conf float, x float, y float, w float, h float"
#: The built-in sample, (track, class, t, x, confidence); y, w, h by track.
SAMPLE_PERSON = [("person-001", "person", 1000 * k, x, c, 0.38, 0.12, 0.38) for k, (x, c) in enumerate([(0.12, 0.91), (0.24, 0.92), (0.38, 0.93), (0.51, 0.94), (0.67, 0.95), (0.76, 0.96)])]
SAMPLE_VEHICLE = [("vehicle-001", "car", 500 + 900 * k, x, 0.88, 0.56, 0.16, 0.20) for k, x in enumerate([0.82, 0.72, 0.58, 0.43, 0.28])]


def sample(spark: SparkSession) -> DataFrame:
    rows = sorted(SAMPLE_PERSON + SAMPLE_VEHICLE, key=lambda r: r[2])
    return spark.createDataFrame([(t, c, ms, n, conf, x, y, w, h) for n, (t, c, ms, x, conf, y, w, h) in enumerate(rows)], OBSERVATION.replace("float", "double"))


def observations(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Observations from JSON files, failing on a malformed record; the built-in sample where no path is given."""
    return sample(spark) if path is None else spark.read.schema(OBSERVATION).option("mode", "FAILFAST").json(path)


def framed(lines: DataFrame, prefix: str, schema: str, most: int = 8 << 20) -> DataFrame:
    """The JSON records of the lines with a prefix, in a frame with a column value; longer lines are an error."""
    own = lines.where(F.startswith("value", F.lit(prefix)))
    body = F.when(F.octet_length("value") > most, F.raise_error(F.lit("line too long")).cast("string")).otherwise(F.substring("value", len(prefix) + 1, most))
    return own.select(F.from_json(body, schema).alias("r")).select("r.*")


def last_framed(lines: DataFrame, prefix: str, schema: str, key: str, most: int = 256) -> DataFrame:
    """The records of the last line with a prefix of each key: one object, or up to `most` under "sessions"; a key without
    such a line, or with too many sessions, is an error. lines: key, nth, value."""
    own = F.when(F.startswith(F.trim("value"), F.lit(prefix)), F.substring(F.trim("value"), len(prefix) + 1, 1 << 30))
    last = lines.groupBy(key).agg(F.max_by(own, F.when(own.isNotNull(), F.col("nth"))).alias("body"))
    body = F.when(F.col("body").isNull(), F.raise_error(F.lit("no framed result")).cast("string")).otherwise(F.col("body"))
    parsed = last.select(key, body.alias("body")).select(key, F.from_json("body", f"sessions array<struct<{schema}>>").getField("sessions").alias("many"), F.from_json("body", f"struct<{schema}>").alias("one"))
    n = F.size("many")
    rows = F.when(F.col("many").isNull(), F.array("one")).when(n.between(1, most), F.col("many")).otherwise(F.raise_error(F.lit("session limit")).cast(f"array<struct<{schema}>>"))
    return parsed.select(key, F.posexplode(rows).alias("session", "r")).select(key, "session", "r.*")


def detector_stream(spark: SparkSession, path: str, prefix: str, schema: str, most_files: int = 100) -> DataFrame:
    """The records of framed lines as they land in a folder, from many cameras at once; a file is read once."""
    return framed(spark.readStream.option("maxFilesPerTrigger", most_files).text(path), prefix, schema)


def files(spark: SparkSession, path: str, most: int = 2 << 30) -> DataFrame:
    """path, length and SHA-256 of each file; one of more than `most` bytes is an error."""
    rows = spark.read.format("binaryFile").load(path)
    sha = F.when(F.col("length") > most, F.raise_error(F.lit("file too large")).cast("string")).otherwise(F.sha2("content", 256))
    return rows.select("path", "length", sha.alias("sha256"))


def uuid7() -> Column:
    """A random id that begins with the time in milliseconds (RFC 9562, version 7)."""
    random = F.regexp_replace(F.expr("uuid()"), "-", "")
    time = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    return F.concat_ws("-", F.substring(time, 1, 8), F.substring(time, 9, 4), F.concat(F.lit("7"), F.substring(random, 14, 3)), F.substring(random, 17, 4), F.substring(random, 21, 12))


def envelopes(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """key and value of each row as a sink's message, ready for format("kafka")."""
    payload = F.to_json(F.struct(F.lit(1).alias("schema_version"), uuid7().alias("message_id"), F.col(key).cast("string").alias("job_id"), F.lit(kind).alias("kind"), F.struct("*").alias("payload")))
    return rows.select(F.col(key).cast("string").alias("key"), payload.alias("value"))


def discarded(rows: DataFrame) -> None:
    """Runs a frame and keeps nothing of it."""
    rows.write.format("noop").mode("overwrite").save()


def published(rows: DataFrame, root: str) -> str:
    """The frame as JSON in a new folder below root; readers see it whole once its _SUCCESS file is there."""
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.json(path)
    return path


def checkpointed(results: DataFrame, root: str, most_bytes: int = 32 << 20) -> DataFrame:
    """job, camera, sha256, bytes of each camera's results, which are written as JSON documents below root, partitioned by job;
    one of more than `most_bytes` is an error, and URLs lose what may be secret. results: job, camera, session, url, payload."""
    from ..functions.ids import redacted_url

    part = F.struct("session", redacted_url(F.col("url")).alias("url"), "payload")
    docs = results.groupBy("job", "camera").agg(F.to_json(F.array_sort(F.collect_list(part))).alias("body"))
    size = F.octet_length("body")
    docs = docs.withColumn("body", F.when(size > most_bytes, F.raise_error(F.lit("checkpoint too large")).cast("string")).otherwise(F.col("body")))
    docs.write.mode("append").partitionBy("job").parquet(root)
    stored = results.sparkSession.read.parquet(root)
    return stored.select("job", "camera", F.sha2("body", 256).alias("sha256"), F.octet_length("body").alias("bytes"))


def reusable(checkpoints: DataFrame, manifest: DataFrame) -> DataFrame:
    """job, camera, state of stored checkpoints against a manifest of their hashes: reuse, changed or missing."""
    want = manifest.select("job", "camera", F.col("sha256").alias("want"))
    rows = want.join(checkpoints.select("job", "camera", F.col("sha256").alias("have")), ["job", "camera"], "left")
    return rows.select("job", "camera", F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("want"), "reuse").otherwise("changed").alias("state"))


def insertable(vectors: DataFrame, store: DataFrame, dimension: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vectors with violation: what may be appended to a store has none; dimension, finite, zero or duplicate otherwise (of
    the new ones, too). Sound ones get their sign bits."""
    from ..functions.vectors import sign_bits

    v = F.col(embedding)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    known = store.select(F.col(vec_id)).distinct().withColumn("known", F.lit(True))
    same = F.count("*").over(Window.partitionBy(vec_id))
    rows = vectors.withColumn("same", same).join(known, vec_id, "left")
    why = F.when(F.coalesce(F.size(v), F.lit(0)) != dimension, "dimension").when(bad, "finite").when(F.forall(v, lambda x: x == 0), "zero").when(F.coalesce("known", F.lit(False)) | (F.col("same") > 1), "duplicate")
    return rows.withColumn("violation", why).withColumn("signs", F.when(F.col("violation").isNull(), sign_bits(v))).drop("same", "known")


def backup(rows: DataFrame, root: str, key: str) -> str:
    """A snapshot of rows below root, with a hash for each; its path."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    rows.withColumn("_sha256", F.sha2(F.to_json(F.struct("*")), 256)).write.parquet(path)
    return path


def restored(spark: SparkSession, path: str, key: str, then: DataFrame, now: DataFrame) -> DataFrame:
    """A snapshot's rows but those revoked when it was taken or since; a row that has changed is an error."""
    rows = spark.read.parquet(path)
    whole = [c for c in rows.columns if c != "_sha256"]
    sound = F.sha2(F.to_json(F.struct(*whole)), 256) == F.col("_sha256")
    rows = rows.where(F.when(sound, True).otherwise(F.raise_error(F.lit("snapshot changed")).cast("boolean"))).select(*whole)
    return rows.join(then.select(key).union(now.select(key)).distinct(), key, "left_anti")


def manifests(spark: SparkSession, path: str, schema: str, versions: tuple[int, ...] = (1,), policy: str | None = None) -> DataFrame:
    """Job manifests, failing on a storage version that isn't known; interrupted jobs come back as failed. Of another media
    policy than the one asked, none come back."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.where(F.when(F.col("version").isin(*versions), True).otherwise(F.raise_error(F.lit("unsupported storage version")).cast("boolean")))
    rows = rows.where(F.col("policy") == policy) if policy is not None else rows
    return rows.withColumn("state", F.when(F.col("state").isin("running", "queued"), "failed").otherwise(F.col("state")))


def cached(keys: DataFrame, store: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """The stored rows for keys, and the keys still to be computed."""
    return store.join(keys, key, "left_semi"), keys.join(store, key, "left_anti")


def trajectories(rows: DataFrame, path: str) -> None:
    """Appended by month, clustered by cell, curve position and time, so that row-group statistics prune scans."""
    rows = rows.withColumn("month", F.date_format(F.timestamp_millis("t"), "yyyyMM"))
    rows.repartitionByRange("cell", "hilbert").sortWithinPartitions("cell", "hilbert", "t").write.mode("append").partitionBy("month").parquet(path)
