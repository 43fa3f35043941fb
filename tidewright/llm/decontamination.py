"""Benchmark decontamination by Wu-Manber search over words.

The alphabet is words, a block is two of them. A shift table keyed by blocks skips positions at which no
window can end; where the shift is zero, the hash of a longer suffix selects the windows that may end there and a
direct comparison of all words confirms them.

Defined results: a null or wordless text has no words and no hits. A benchmark item without words has no windows. An
item with a null id still marks words as hit, but isn't listed. Repeated items with one id count once. Rows of
documents are kept one for one, repeated ones as well, and other columns pass through unchanged.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written

WINDOW = 13
#: A block of benchmark text; its windows take about 200 times its bytes, on the driver and in each worker.
BLOCK_BYTES = 2 << 20
TYPE = "struct<n_words: bigint, hits: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

#: A-Z to a-z; digits, a-z and all bytes of non-ASCII characters stay; the rest separates words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class WuManber:
    """Finds every occurrence of patterns, tuples of words each at least as long as the shortest."""

    SUFFIX = 4

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[int, ...]]):
        self.m = min(map(len, patterns))
        self.block = min(2, self.m)
        self.suffix = min(self.SUFFIX, self.m)
        self.default = self.m - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for words, owners in patterns.items():
            for end in range(self.block, self.m + 1):
                key = words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])
                self.shift[key] = min(self.shift.get(key, self.default), self.m - end)
            self.bucket.setdefault(words[self.m - self.suffix : self.m], []).append((words, owners))

    def find(self, words: list[bytes]):
        """(start, end, owners) by start."""
        m, shift, bucket, suffix, default, pairs = self.m, self.shift.get, self.bucket.get, self.suffix, self.default, self.block == 2
        i, n = m - 1, len(words)
        while i < n:
            skip = shift((words[i - 1], words[i]) if pairs else words[i], default)
            if skip:
                i += skip
                continue
            start = i - m + 1
            for pattern, owners in bucket(tuple(words[i + 1 - suffix : i + 1]), ()):
                if tuple(words[start : start + len(pattern)]) == pattern:
                    yield start, start + len(pattern), owners
            i += 1


class Matcher:
    """All windows of some benchmark items: full windows in one search, the items shorter than a window in another."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        full: dict[tuple[bytes, ...], set[int]] = {}
        short: dict[tuple[bytes, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        for name, text in items:
            words = tuple(words_of(text))
            into = full if len(words) >= window else short
            for i in range(max(len(words) - window, 0) + 1 if words else 0):
                into.setdefault(words[i : i + window], set()).update(() if name is None else (number[name],))
        self.searches = [WuManber({k: tuple(v) for k, v in x.items()}) for x in (full, short) if x]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """The merged stretches of hit words and the sorted ids of the items with an occurring window."""
        found: list[tuple[int, int]] = []
        owners: set[int] = set()
        for search in self.searches:
            for start, end, own in search.find(words):
                found.append((start, end))
                owners.update(own)
        return merged(found), [self.names[k] for k in sorted(owners)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def _udf(shared):
    @F.arrow_udf(TYPE)
    def search(texts: pa.Array, before: pa.Array) -> pa.Array:
        matcher, out = shared.value, []
        for text, old in zip(texts, before.to_pylist(), strict=True):
            words = words_of(text.as_py())
            spans, items = matcher.match(words)
            if old:
                spans = merged(spans + [(x["start"], x["end"]) for x in old["hits"]])
                items = sorted({*items, *old["items"]})
            out.append({"n_words": len(words), "hits": [{"start": a, "end": b} for a, b in spans], "items": items})
        return pa.array(out, _ARROW)

    return search


def matched(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column named into: n_words; hits, merged word positions [start, end); items, sorted ids.

    The benchmark, a stated set of test texts, is measured first. Up to block_bytes go to the executors at once; of a
    larger one, a block after the other: the rows with what was found so far are written in between, and the block before
    is given up, so that a task holds one block only. Nothing is shuffled.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.encode(item_text, "utf-8").alias("text")).where(F.length("text") > 0)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found: Column = F.lit(None).cast(TYPE)
    out = docs
    with Scratch(spark) as s:
        for k in range(blocks):
            rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()
            shared = spark.sparkContext.broadcast(Matcher([(r["id"], bytes(r["text"])) for r in rows], window))
            out = out.withColumn(into, _udf(shared)(F.encode(F.col(text), "utf-8"), found))
            found = F.col(into)
            if k + 1 < blocks:
                out, before = s.write(out, "searched"), out
                s.drop(before)
                shared.destroy()
        return written(out, "searched") if blocks > 1 else out


def n_hit(found: str) -> Column:
    return F.aggregate(F.col(f"{found}.hits"), F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])


def contaminated(found: str) -> Column:
    """At least a twentieth of the words, and at least one, lie inside benchmark windows."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= F.col(f"{found}.n_words"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, table(spark, sf_dir, "benchmark"), "found")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), n_hit("found").alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), contaminated("found").alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM win), pos AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS key
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), occ AS (SELECT doc_id, pos.k, i, item FROM pos JOIN win ON pos.k = win.k AND pos.key = win.key),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
