"""Sharding by extendible hashing.

A row's address is a string of bits: 60 of a hash of its key, then 60 of a hash of the whole row, which part the rows of
a hot key. A shard is a prefix of addresses. Only a shard over the byte limit is split on its next bit. The directory
maps slots, prefixes of one length, to the depth of their shard; slots that are still over the limit get a directory of
their own with more bits.

Defined results: a null key is a key like any other. Rows alike in every column share an address; where these alone
exceed the limit, they go to overflow shards ("prefix+input partition.number") of as many as fit. A row larger than
the limit has a shard to itself, with oversize true. An empty table has no shards. A null size counts as 0 bytes.
Columns that are called like the added ones count for the address but are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

LIMIT = 64 << 20
#: The query's limit, by which tables of all sizes are split.
QUERY_LIMIT = 256 << 10
ADDED = ("n_bytes", "shard", "depth", "oversize")
BITS, STEP, SPARE = 120, 8, 3
#: Directories of at most so many slots are broadcast, at under 100 bytes each; larger ones are joined by shuffle.
BROADCAST_SLOTS = 50_000


def _bits(value: Column) -> Column:
    return F.lpad(F.bin(F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")), 60, "0")


def address(key: Column, row: list[Column]) -> Column:
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    content = F.to_json(F.struct(*row), {"ignoreNullFields": "false"})
    return F.concat(_bits(F.encode(text, "utf-8")), _bits(F.encode(content, "utf-8")))


def _directory(cells: DataFrame, depth: int, base: int, limit: int) -> DataFrame:
    """slot, leaf (the depth of its shard; null: over the limit even at this depth), rows. cells: slot, bytes, n."""
    nodes = cells.select("slot", "bytes", "n", F.explode(F.sequence(F.lit(base), F.lit(depth))).alias("d"))
    sums = nodes.groupBy("d", F.expr("substring(slot, 1, d)").alias("node")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    # A node fits if it's within the limit or a single row; prefixes of a fitting node's rows fit as well.
    fits = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1)).select("d", "node")
    probe = nodes.select("slot", "d", F.expr("substring(slot, 1, d)").alias("node"))
    leaf = probe.join(fits, ["d", "node"]).groupBy("slot").agg(F.min("d").alias("leaf"))
    return cells.join(leaf, "slot", "left").select("slot", "leaf")


def sharded(df: DataFrame, key: str, size: Column, limit: int = LIMIT, columns: list[str] | None = None) -> DataFrame:
    """columns of df (default: all), with n_bytes, shard (string), depth (bits of its prefix) and oversize (boolean).

    The columns returned are written to the shared folder once with their addresses; the address covers all of df.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    own = [df[c] for c in (columns or df.columns) if c.lower() not in ADDED]
    rows = df.select(F.struct(*own).alias("row"), address(df[key], [df[c] for c in df.columns]).alias("bits"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n_bytes"), F.spark_partition_id().alias("part"))
    rows = written(rows, "addresses")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth, base = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit)) + SPARE)), 0
    todo = rows.select("bits", "n_bytes")
    directories: list[tuple[int, DataFrame]] = []
    while True:
        cells = todo.groupBy(F.substring("bits", 1, depth).alias("slot")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        directory = written(_directory(cells, depth, base, limit), "directory")
        directories.append((depth, directory))
        over = directory.where("leaf IS NULL").select(F.col("slot").alias("full"))
        if depth == BITS or not over.limit(1).count():
            break
        todo = todo.join(over, F.substring("bits", 1, depth) == F.col("full"), "left_semi")
        base, depth = depth, min(BITS, depth + STEP)
    out = rows
    leaf = F.lit(None).cast("int")
    for k, (bits, directory) in enumerate(directories):
        small = directory.count() <= BROADCAST_SLOTS
        side = directory.select(F.col("slot").alias(f"slot{k}"), F.col("leaf").alias(f"leaf{k}"))
        out = out.join(F.broadcast(side) if small else side, F.substring("bits", 1, bits) == F.col(f"slot{k}"), "left")
        leaf = F.coalesce(leaf, f"leaf{k}")
    out = out.select("row", "n_bytes", "bits", "part", leaf.alias("leaf"))
    shard, at = F.expr("substring(bits, 1, leaf)"), F.coalesce("leaf", F.lit(BITS))
    placed = out.where("leaf IS NOT NULL").select("row.*", "n_bytes", shard.alias("shard"), at.alias("depth"), (F.col("n_bytes") > limit).alias("oversize"))
    nth = F.row_number().over(Window.partitionBy("bits", "part").orderBy("n_bytes")) - 1
    alike = out.where("leaf IS NULL").withColumn("nth", nth)
    fit = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    overflow = F.concat("bits", F.lit("+"), "part", F.lit("."), F.floor(F.col("nth") / fit))
    return placed.unionByName(alike.select("row.*", "n_bytes", overflow.alias("shard"), at.alias("depth"), (F.col("n_bytes") > limit).alias("oversize")))


def write(df: DataFrame, key: str, size: Column, path: str, limit: int = LIMIT) -> None:
    """The rows as Parquet, a folder for each shard; the rows of a shard are written by one task."""
    out = sharded(df, key, size, limit)
    out.repartition(F.col("shard")).write.partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharded(docs, "doc_id", F.octet_length("text"), QUERY_LIMIT, ["doc_id"]).select("doc_id", F.col("n_bytes"), "shard", F.col("depth").cast("bigint").alias("depth"), "oversize")


#: Addresses of distinct keys differ within the first 60 bits here, so the key's bits are enough.
SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, lpad(to_base(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), 2), 60, '0') AS bits FROM documents
), p AS (SELECT doc_id, n_bytes, k, substr(bits, 1, k) AS node FROM (SELECT *, unnest(range(0, 40)) AS k FROM d)),
s AS (SELECT k, node, sum(n_bytes) AS bytes, count(*) AS n FROM p GROUP BY k, node),
leaf AS (SELECT doc_id, min(p.k) AS depth, min(n_bytes) AS n_bytes FROM p JOIN s ON p.k = s.k AND p.node = s.node WHERE bytes <= {QUERY_LIMIT} OR n = 1 GROUP BY doc_id)
SELECT d.doc_id, d.n_bytes, substr(bits, 1, depth) AS shard, depth, d.n_bytes > {QUERY_LIMIT} AS oversize FROM d JOIN leaf ON d.doc_id = leaf.doc_id
"""
