"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged.

Equal vectors form one node with its smallest ids, one more than are asked for, so that no number of copies can fill a
graph's neighbour lists or a result. Nodes go to shards of about `shard` by the hash of their vector. Each shard's graph
is one row: its vectors, levels and neighbours as flat arrays. Queries visit all shards, in blocks of bounded size.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id. Of several vectors with one id the smallest, component by component, stands. Distances are between
vectors of equal length only. Ties in distance go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SHARD, LINKS, BUILD, SEARCH, BLOCK = 8_192, 12, 64, 96, 4_096


class Graph:
    """The graph of one shard. On each level row i of `links[level]` holds the neighbours of the node i, then -1."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray]):
        self.x = vectors
        self.norm = np.einsum("ij,ij->i", vectors, vectors)
        self.levels, self.links = levels, links

    @classmethod
    def build(cls, vectors: np.ndarray, draws: np.ndarray, m: int = LINKS, width: int = BUILD) -> Graph:
        """draws: a number in [0, 1) for each node, which sets its level."""
        n = len(vectors)
        levels = np.minimum((-np.log(1 - draws * 0.999999) / math.log(m)).astype(int), 8)
        g = cls(vectors, levels, [np.full((n, 4 * m if k == 0 else 2 * m), -1, np.int32) for k in range(int(levels.max(initial=0)) + 1)])
        degree = [np.zeros(n, int) for _ in g.links]
        top, start = -1, 0
        for i in range(n):
            level = int(levels[i])
            near = [start]
            for k in range(top, level, -1):
                near = [g._search(vectors[i], near, 1, k)[0][1]]
            for k in range(min(top, level), -1, -1):
                found = g._search(vectors[i], near, width, k)
                most = g.links[k].shape[1] // 2
                chosen = g._spread(found, m if k else 2 * m)
                g.links[k][i, : len(chosen)] = chosen
                degree[k][i] = len(chosen)
                for j in chosen:
                    if degree[k][j] == g.links[k].shape[1]:
                        own = g.links[k][j]
                        d = g._distances(vectors[j], own)
                        kept = g._spread(sorted(zip(d.tolist(), own.tolist(), strict=True)), most)
                        g.links[k][j] = -1
                        g.links[k][j, : len(kept)] = kept
                        degree[k][j] = len(kept)
                    g.links[k][j, degree[k][j]] = i
                    degree[k][j] += 1
                near = [j for _, j in found]
            if level > top:
                top, start = level, i
        return g

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """The nearest that are nearer to the node than to one chosen before; then the nearest of the rest."""
        ids = np.array([j for _, j in found])
        if len(ids) <= most // 2:
            return ids.tolist()
        x = self.x[ids]
        norm = self.norm[ids]
        between = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
        chosen, rest = [], []
        nearest = np.full(len(ids), np.inf)
        for k, (d, _) in enumerate(found):
            if len(chosen) == most:
                break
            if d <= nearest[k]:
                chosen.append(k)
                np.minimum(nearest, between[k], out=nearest)
            else:
                rest.append(k)
        return ids[chosen + rest[: most // 2 - len(chosen) if len(chosen) < most // 2 else 0]].tolist()

    def _search(self, q: np.ndarray, near: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """Up to `width` (squared distance, node), nearest first."""
        links, seen = self.links[level], self._seen()
        ids = np.array(near)
        seen[ids] = True
        touched = [ids]
        todo = sorted(zip(self._distances(q, ids).tolist(), near, strict=True))
        best = [(-d, j) for d, j in todo]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if d > -best[0][0] and len(best) >= width:
                break
            new = links[i]
            new = new[new >= 0]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            touched.append(new)
            far = self._distances(q, new)
            for e, j in zip(far.tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-e, j))
                    heapq.heappush(todo, (e, j))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, j))
                    heapq.heappush(todo, (e, j))
        for t in touched:
            seen[t] = False
        return sorted((-d, j) for d, j in best)

    def _seen(self) -> np.ndarray:
        if not hasattr(self, "_marks"):
            self._marks = np.zeros(len(self.x), bool)
        return self._marks

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        near = [int(np.argmax(self.levels))]
        for k in range(len(self.links) - 1, 0, -1):
            near = [self._search(q, near, 1, k)[0][1]]
        return [j for _, j in self._search(q, near, width, 0)]


def _sound(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def index(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, shard: int = SHARD) -> DataFrame:
    """The index, a row for each shard: dim, part, x (vectors), levels, links (one flat array for each level), ids (for
    each node its up to k + 1 smallest, padded with the last) and many (how many of them there are)."""
    clean = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _sound(F.col("v")))
    clean = clean.groupBy("id").agg(F.min("v").alias("v"))
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = clean.withColumn("k", least).where(F.col("k") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = written(nodes, "nodes")
    sizes = nodes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    parts = sizes.select("dim", F.ceil(F.col("n") / shard).alias("parts"))
    placed = nodes.withColumn("dim", F.size("v")).join(F.broadcast(parts) if parts.count() <= 10_000 else parts, "dim")
    placed = placed.select("dim", F.pmod(F.xxhash64("v"), "parts").alias("part"), F.pmod(F.xxhash64("v", F.lit(1)), F.lit(1 << 30)).alias("draw"), "v", "ids")

    def build(rows: pa.Table) -> pa.Table:
        x = np.stack([np.array(v) for v in rows["v"].to_pylist()])
        order = np.lexsort(x.T[::-1])  # the graph doesn't depend on the order of arrival
        x, ids = x[order], [rows["ids"][int(i)].as_py() for i in order]
        g = Graph.build(x, rows["draw"].to_numpy()[order] / (1 << 30))
        flat = np.array([i + i[-1:] * (k + 1 - len(i)) for i in ids], np.int64)
        return pa.table({
            "dim": pa.array([x.shape[1]], pa.int32()), "part": pa.array([rows["part"][0].as_py()], pa.int64()), "x": pa.array([x.tobytes()], pa.binary()), "levels": pa.array([g.levels.astype(np.int32).tobytes()], pa.binary()),
            "links": pa.array([[a.tobytes() for a in g.links]], pa.list_(pa.binary())), "ids": pa.array([flat.tobytes()], pa.binary()), "many": pa.array([np.array([len(i) for i in ids], np.int32).tobytes()], pa.binary()),
        })

    shards = parts.agg(F.sum("parts")).first()[0] or 1
    placed = placed.repartitionByRange(shards, "dim", "part")  # by hash, several graphs may meet in one task
    return placed.groupBy("dim", "part").applyInArrow(build, "dim int, part bigint, x binary, levels binary, links array<binary>, ids binary, many binary")


def search(indexed: DataFrame, queries: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 10, width: int = SEARCH, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, other than its own id."""
    spark = queries.sparkSession
    asked = queries.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _sound(F.col("v")))
    asked = written(asked.groupBy("id").agg(F.min("v").alias("v")), "queries")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about `block` rows
        shared = spark.sparkContext.broadcast([(r["id"], np.array(r["v"])) for r in rows])

        def look(batches, shared=shared):
            for batch in batches:
                for row in batch.to_pylist():
                    x = np.frombuffer(row["x"]).reshape(-1, row["dim"])
                    n = len(x)
                    g = Graph(x, np.frombuffer(row["levels"], np.int32), [np.frombuffer(a, np.int32).reshape(n, -1) for a in row["links"]])
                    ids, many = np.frombuffer(row["ids"], np.int64).reshape(n, -1), np.frombuffer(row["many"], np.int32)
                    out: list[tuple[int, int, float]] = []
                    for q, v in shared.value:
                        if len(v) != row["dim"]:
                            continue
                        got = [(float(np.sqrt(((x[j] - v) ** 2).sum())), int(i)) for j in g.nearest(v, width) for i in ids[j, : many[j]] if i != q]
                        out += [(q, i, d) for d, i in heapq.nsmallest(k, got)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        part = indexed.mapInArrow(look, "query_id bigint, vec_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    indexed = written(index(rows), "index")
    shards = max(1, indexed.count())
    return search(indexed.repartition(shards, "dim", "part"), rows.where(F.col("vec_id") % 100 == 0))
