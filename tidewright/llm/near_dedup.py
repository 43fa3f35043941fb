"""Near-duplicate documents by ProbMinHash over weighted word shingles.

Each shingle is the source of a Poisson process with its weight as rate; every arrival goes to a random slot of the
signature, and the first arrival in a slot names its winner. Arrivals later than the latest winner can't count, which
ends the work early. The chance that two signatures agree in a slot is the probability Jaccard similarity. Bands of
slots give candidate pairs, and the shingle sets of each pair verify it. A text with repeated shingles has a second
signature with all weights 1, whose slots agree with the chance of the plain Jaccard similarity; of others it is the same.

Documents with the same words form one node. In each bucket of a band, nodes are compared with the bucket's hub, the
node that shares most buckets with others. Where a bucket's nodes then still belong to several classes, all its pairs of
different classes are compared: a large bucket is dealt out as pairs of blocks, and shingles common to two nodes are
counted for a pair of blocks at once. So each pair that shares a band is verified or already in one class; no bucket is
cut. The work grows with the square of a bucket that no class fills. Of pairs with similarity 0.8, 1 in 300,000 shares
no band.

Defined results: words are runs of a-z (A-Z lower-cased), digits and non-ASCII characters; a shingle is five of them, or
all words of a text with fewer. A text without words, or null, is a class of its own. Rows without an id have no class
and are never dropped. Repeated rows of one id and text are copies. Two documents are linked if the plain Jaccard or
the probability Jaccard similarity (of shingle counts) of their shingles, told apart by 32 bits, is `similarity` or
more; a class is what links connect, and its id is its smallest document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table, written
from .decontamination import words_of

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 5
#: Nodes and bytes of shingles of a block, and columns of shingles counted at a time; they bound a task's memory only.
BLOCK, BLOCK_BYTES, COLUMNS = 1024, 1 << 23, 2048
_GOLD, _M1, _M2, _P = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x100000001B3))


class _Hashes(dict):
    """Hashes of words; bounded, as it only saves work."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles, and how often each occurs."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    total = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        total = total * _P + h[k : len(h) - size + 1 + k]
    return np.unique(_mixed(total + np.uint64(size)), return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """ProbMinHash of each (items, weights): a row of slots, in each the item whose exponential arrival came first.

    Sets that need about as many arrivals of each item are worked on together.
    """
    out = np.empty((len(sets), slots), np.uint64)
    needed = 1.2 * slots * (np.log(slots) + 0.58)
    alike: dict[int, list[int]] = {}
    for k, (items, _) in enumerate(sets):
        alike.setdefault(1 << int(np.ceil(np.log2(max(needed / len(items), 1)))), []).append(k)
    for take, members in alike.items():
        block: list[int] = []
        size = 0
        for k in members:
            block.append(k)
            size += len(sets[k][0]) * take
            if size >= 100_000:
                out[block] = _race([sets[i] for i in block], slots, take)
                block, size = [], 0
        if block:
            out[block] = _race([sets[i] for i in block], slots, take)
    return out


def _race(sets: list[tuple[np.ndarray, np.ndarray]], slots: int, take: int) -> np.ndarray:
    items = np.concatenate([x for x, _ in sets])
    rate = np.concatenate([w for _, w in sets]).astype(float)
    of = np.repeat(np.arange(len(sets)), [len(x) for x, _ in sets])
    first, winner = np.full(len(sets) * slots, np.inf), np.zeros(len(sets) * slots, np.int64)
    alive, clock, done = np.arange(len(items)), np.zeros(len(items)), 0
    with np.errstate(over="ignore"):
        while len(alive):
            v = _mixed(items[alive][:, None] + np.arange(done + 1, done + take + 1, dtype=np.uint64) * _GOLD)
            gap = -np.log(((v >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[alive][:, None]
            times = clock[:, None] + np.cumsum(gap, axis=1)
            where = (((v & np.uint64(0x7FF)) * np.uint64(slots) >> np.uint64(11)).astype(np.int64) + of[alive][:, None] * slots).ravel()
            flat = times.ravel()
            np.minimum.at(first, where, flat)
            won = np.flatnonzero(flat == first[where])
            winner[where[won]] = alive[won // take]
            clock = times[:, -1]
            on = clock < first.reshape(-1, slots).max(axis=1)[of[alive]]  # later arrivals can't win any more
            alive, clock = alive[on], clock[on]
            done, take = done + take, max(1, take // 4)
    return items[winner].reshape(len(sets), slots)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of keys, one for each band, for each signature."""
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for k in range(rows):
            key = _mixed(key * _P + sig.reshape(-1, bands, rows)[:, :, k])
    return key.view(np.int64)


_SKETCH = "struct<fp: binary, bands: array<bigint>, items: binary, counts: binary>"
_ARROW = pa.struct([("fp", pa.binary()), ("bands", pa.list_(pa.int64())), ("items", pa.binary()), ("counts", pa.binary())])
#: Texts whose shingles a worker unpacks before it hands their sketches on.
AT_ONCE = 250


def _sketched(texts: pa.Array, size: int, bands: int, rows: int) -> list[dict | None]:
    out, sets, keyed = [], [], []
    for x in texts:
        words = words_of(x.as_py())
        if not words:
            out.append({"fp": None, "bands": None, "items": None, "counts": None})
            continue
        with np.errstate(over="ignore"):
            got, many = shingles(words, size)
        sets.append((got, many))
        repeats = bool(many.max() > 1)
        if repeats:
            sets.append((got, np.ones_like(many)))
        out.append({"fp": hashlib.md5(b" ".join(words)).digest(), "items": (got >> np.uint64(32)).astype("<u4").tobytes(), "counts": many.astype("<u4").tobytes() if repeats else b""})
        keyed.append((out[-1], len(sets)))
    made = band_keys(signatures(sets, bands * rows), bands, rows)
    low = 0
    for row, high in keyed:
        row["bands"], low = np.unique(made[low:high]), high
    return out


def _sketch_udf(size: int, bands: int, rows: int):
    @F.arrow_udf(_SKETCH)
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for i in range(0, max(len(texts), 1), AT_ONCE):
                yield pa.array(_sketched(texts[i : i + AT_ONCE], size, bands, rows), _ARROW)

    return sketch


def likeness(a: bytes, wa: bytes, b: bytes, wb: bytes) -> tuple[float, float]:
    """Plain and probability Jaccard similarity of two packed shingle sets with their counts."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    _, i, j = np.intersect1d(x, y, return_indices=True)
    plain = len(i) / (len(x) + len(y) - len(i))
    if not wa and not wb:
        return plain, plain
    u = np.frombuffer(wa, "<u4").astype(float) if wa else np.ones(len(x))
    v = np.frombuffer(wb, "<u4").astype(float) if wb else np.ones(len(y))
    p, q = u[i], v[j]
    order = np.argsort(p / q, kind="stable")
    p, q = p[order], q[order]
    ratio = p / q
    # For a common shingle d: the sum over all d' of max(u[d'] / u[d], v[d'] / v[d]).
    above = u.sum() - np.concatenate([[0], np.cumsum(p)])[np.searchsorted(ratio, ratio, "left")]
    below = v.sum() - q.sum() + np.concatenate([[0], np.cumsum(q)])[np.searchsorted(ratio, ratio, "left")]
    return plain, float((1 / (above / p + below / q)).sum())


def _like_udf(least: float):
    @F.arrow_udf("boolean")
    def like(a: pa.Array, wa: pa.Array, b: pa.Array, wb: pa.Array) -> pa.Array:
        return pa.array([max(likeness(w.as_py(), x.as_py(), y.as_py(), z.as_py())) >= least for w, x, y, z in zip(a, wa, b, wb, strict=True)], pa.bool_())

    return like


def _counted(x: list[np.ndarray], u: list[np.ndarray], y: list[np.ndarray], v: list[np.ndarray], weighted: bool) -> list[np.ndarray]:
    """For each of x with each of y, sets of shingles with weights u and v: how many are common, and then the sums of the
    common ones' weights u and v."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = [np.zeros((len(x), len(y)), np.float32) for _ in range(3 if weighted else 1)]

    def placed(sets, weights):
        of, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        column = np.searchsorted(shared, at)
        held = np.flatnonzero(np.append(shared, 0)[column] == at) if len(shared) else np.zeros(0, np.int64)
        held = held[column[held] < len(shared)]
        held = held[np.argsort(column[held], kind="stable")]
        return of[held], column[held], np.concatenate(weights)[held].astype(np.float32) if weighted else None

    def dense(rows, part, low, wide, values):
        m = np.zeros((rows, wide), np.float32)
        m[part[0], part[1] - low] = values
        return m

    left, right = placed(x, u), placed(y, v)
    for low in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - low)
        a, b = (tuple(c[slice(*np.searchsorted(s[1], [low, low + wide]))] if c is not None else None for c in s) for s in (left, right))
        one, two = dense(len(x), a, low, wide, 1), dense(len(y), b, low, wide, 1).T
        out[0] += one @ two
        if weighted:
            out[1] += dense(len(x), a, low, wide, a[2]) @ two
            out[2] += one @ dense(len(y), b, low, wide, b[2]).T
    return out


def _joined(left: list[tuple], right: list[tuple], least: float) -> list[tuple[bytes, bytes]]:
    """Linked pairs of a node of left and one of right, of (fp, class, items, counts), that join all classes linked."""
    root: dict[int, int] = {}

    def find(c):
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    out: list[tuple[bytes, bytes]] = []

    def join(r, s):
        root[find(r[1])] = find(s[1])
        out.append((r[0], s[0]))

    if len(left) * len(right) <= 16:
        for r in left:
            for s in right:
                if find(r[1]) != find(s[1]) and max(likeness(*r[2:], *s[2:])) >= least:
                    join(r, s)
        return out
    unpack = lambda rows: [np.frombuffer(r[2], "<u4") for r in rows]
    x, y = unpack(left), unpack(right)
    repeats = np.array([bool(r[3]) for r in left])[:, None] | np.array([bool(s[3]) for s in right])[None, :]
    weighted = bool(repeats.any())
    shares = lambda rows, sets: [w / w.sum() for r, s in zip(rows, sets, strict=True) for w in [np.frombuffer(r[3], "<u4").astype(float) if r[3] else np.ones(len(s))]] if weighted else []
    common, *sums = _counted(x, shares(left, x), y, shares(right, y), weighted)
    common = common.astype(float)
    names, number = np.unique([r[1] for r in [*left, *right]], return_inverse=True)
    c, d = number[: len(left)], number[len(left) :]
    apart = c[:, None] != d[None, :]
    plain = common / (np.array([len(a) for a in x])[:, None] + np.array([len(b) for b in y])[None, :] - common)
    i, j = np.nonzero((plain >= least) & apart)
    _, once = np.unique(c[i] * len(names) + d[j], return_index=True)
    for k in once:
        if find(left[i[k]][1]) != find(right[j[k]][1]):
            join(left[i[k]], right[j[k]])
    if weighted:
        # Two signatures can't agree more often than the smaller of the shares that the common shingles have.
        maybe = repeats & apart & (plain < least) & (np.minimum(*sums) >= least - 1e-3)
        for k, m in np.argwhere(maybe):
            r, s = left[k], right[m]
            if find(r[1]) != find(s[1]) and max(likeness(*r[2:], *s[2:])) >= least:
                join(r, s)
    return out


_DEALT = ("key", "i", "j", "own", "fp", "h", "items", "counts")


def _settle(least: float):
    """Links between the classes of each pair of blocks, whose rows come one after the other."""

    def links(place, rows):
        _, i, j = place
        left, right = ([r[1:] for r in rows if r[0] == k] for k in (i, j))
        return _joined(left, right, least) if left and right and len({r[2] for r in rows}) > 1 else []

    def settle(batches):
        place, rows = None, []
        for batch in batches:
            out = []
            for *at, own, fp, h, items, counts in zip(*(batch.column(k).to_pylist() for k in range(len(_DEALT))), strict=True):
                if at != place:
                    out += links(place, rows) if rows else []
                    place, rows = at, []
                rows.append((own, fp, h, items, counts))
            yield _pairs(out)
        yield _pairs(links(place, rows) if rows else [])

    return settle


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _components(s: Scratch, links: DataFrame) -> DataFrame:
    """v, c: the smallest node of each linked node's component, by rounds of smallest neighbour and pointer jumping."""
    edges = s.write(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = s.write(edges.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("c")))
    while True:
        near = edges.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("n"))
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "n").alias("c"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("j"))
        new = s.write(step.join(jump, "c").select("v", "old", F.least("c", "j").alias("c")))
        s.drop(labels)
        if not new.where(F.col("old") != F.col("c")).limit(1).count():
            s.drop(edges)
            return new
        labels = new


def _mark(text) -> Column:
    return F.unhex(F.md5(F.encode(F.coalesce(text, F.lit("")), "utf-8")))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark, fp, class_id, first: a row for each row of docs with an id. mark tells texts apart, fp their words
    (null: none); class_id is the smallest id of the class, first the smallest mark among that id's texts in the class."""
    with Scratch(docs.sparkSession) as s:
        return written(_classes(s, docs, doc_id, text, size, similarity, bands, rows), "classes")


def _classes(s: Scratch, docs: DataFrame, doc_id: str, text: str, size: int, similarity: float, bands: int, rows: int) -> DataFrame:
    udf = _sketch_udf(size, bands, rows)
    rows_in = docs.select(F.col(doc_id).alias("doc_id"), _mark(F.col(text)).alias("mark"), F.encode(F.col(text), "utf-8").alias("x")).where(F.col("doc_id").isNotNull())
    made = s.write(rows_in.select("doc_id", "mark", udf("x").alias("s")).select("doc_id", "mark", "s.*"), "sketches")
    # Joins here are by shuffle at every size: a side that is small enough to broadcast on little data isn't on much.
    spread = made.where(F.col("fp").isNotNull()).select("fp", F.explode("bands").alias("key"))
    first8 = F.xxhash64("fp")
    live = spread.groupBy("key").agg(F.min(first8).alias("lo"), F.max(first8).alias("hi")).where("lo <> hi").select("key")
    buckets = s.write(spread.join(live.hint("merge"), "key").distinct(), "buckets")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    rank = s.write(buckets.join(sizes.hint("merge"), "key").groupBy("fp").agg(F.sum("n").alias("pr")))
    # The shingles of nodes that share a bucket with another.
    node = made.where(F.col("fp").isNotNull()).select("fp", "items", "counts").join(rank.select("fp").hint("merge"), "fp", "left_semi")
    node = s.write(node.groupBy("fp").agg(F.first("items").alias("items"), F.first("counts").alias("counts")), "nodes")
    ranked = s.write(buckets.join(rank.hint("merge"), "fp").join(node.select("fp", F.length("items").alias("z")).hint("merge"), "fp"), "ranked")
    s.drop(buckets)
    hubs = ranked.groupBy("key").agg(F.max_by("fp", F.struct("pr", "fp")).alias("hub"))
    ask = ranked.join(hubs.hint("merge"), "key").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
    like = _like_udf(similarity)
    # The hub's shingles, a's, come last: they aren't copied through a shuffle.
    with_b = ask.join(node.select(F.col("fp").alias("b"), F.col("items").alias("ib"), F.col("counts").alias("cb")).hint("merge"), "b")
    both = with_b.join(node.select(F.col("fp").alias("a"), F.col("items").alias("ia"), F.col("counts").alias("ca")).hint("merge"), "a")
    links = s.write(both.where(like("ia", "ca", "ib", "cb")).select("a", "b"))
    comp = _components(s, links)
    of = ranked.join(comp.select(F.col("v").alias("fp"), "c").hint("merge"), "fp", "left").select("key", "fp", "z", F.coalesce("c", "fp").alias("c"))
    of = s.write(of.withColumn("h", F.xxhash64("c")))
    s.drop(ranked)
    # What is left are pairs of two classes in one bucket, neither of them its hub. Of buckets with the same nodes one is enough.
    per_class = of.groupBy("key", "h").agg(F.count("*").alias("n"), F.sum("z").alias("z"), *(F.bit_xor(F.xxhash64("fp", F.lit(k))).alias(f"x{k}") for k in (0, 1)))
    whole = per_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("z").alias("z"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1"), F.max(F.struct("n", "z", "h")).alias("top"))
    mixed = whole.where("classes > 1 AND n > 2").groupBy("n", "x0", "x1").agg(F.min(F.struct("key", "z", "top")).alias("m")).select("n", "m.*")
    # A large bucket's most frequent class has blocks of its own, which aren't compared with each other.
    blocks = lambda n, z: F.greatest(F.ceil(n / BLOCK), F.ceil(z / BLOCK_BYTES)).cast("int")
    small = (F.col("n") <= BLOCK) & (F.col("z") <= BLOCK_BYTES)
    mixed = mixed.select("key", F.col("top.h").alias("top"), F.when(small, 0).otherwise(blocks(F.col("top.n"), F.col("top.z"))).alias("p"), F.when(small, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("z") - F.col("top.z"))).alias("q"))
    most = (F.col("h") == F.col("top")) & (F.col("p") > 0)
    salt = lambda k: F.pmod(F.xxhash64("fp", F.lit(2)), F.greatest(k, F.lit(1))).cast("int")
    dealt = of.join(mixed.hint("merge"), "key").withColumn("own", F.when(most, salt(F.col("p"))).otherwise(F.col("p") + salt(F.col("q"))))
    dealt = dealt.select("key", "fp", "h", "own", F.explode(F.sequence(F.when(most, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)).alias("o"))
    dealt = dealt.select("key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "h", "fp").join(node.hint("merge"), "fp").select(*_DEALT)
    found = s.write(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_settle(similarity), "a binary, b binary"))
    # These join classes, of which there are fewer than nodes.
    label = lambda x: of.select(F.col("fp").alias(x), F.col("c").alias(f"c{x}")).distinct().hint("merge")
    wider = _components(s, found.join(label("a"), "a").join(label("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    comp = comp.select(F.col("v").alias("fp"), "c").unionByName(wider.join(comp, "v", "left_anti").select(F.col("v").alias("fp"), F.col("v").alias("c")))
    comp = comp.join(wider.select(F.col("v").alias("c"), F.col("c").alias("w")).hint("merge"), "c", "left").select("fp", F.coalesce("w", "c").alias("c"))
    narrow = made.select("doc_id", "mark", "fp").join(comp.hint("merge"), "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    least = narrow.where(F.col("c").isNotNull()).groupBy("c").agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    out = narrow.join(least.hint("merge"), "c", "left")
    return out.select("doc_id", "mark", "fp", F.coalesce("least.doc_id", "doc_id").alias("class_id"), F.coalesce("least.mark", "mark").alias("first"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row left of each class, the one with the smallest id and, of that id's texts, the smallest mark."""
    who, nth, mark, gone_mark, spot = (fresh(docs, x) for x in ("id", "nth", "mark", "gone", "spot"))
    of = classes(docs, doc_id, text, **how).where("doc_id <> class_id OR mark <> first")
    # Rows without an id are spread by their text; they match nothing.
    at = lambda i, m: F.when(i.isNull(), F.xxhash64(m)).otherwise(F.xxhash64(i))
    gone = of.select(at(F.col("doc_id"), F.col("mark")).alias(f"{spot}_"), F.col("doc_id").alias(who), F.col("mark").alias(gone_mark)).distinct()
    rows = docs.withColumn(mark, _mark(F.col(text))).withColumn(spot, at(F.col(doc_id), F.col(mark)))
    kept = rows.join(gone.hint("merge"), (F.col(spot) == F.col(f"{spot}_")) & (F.col(doc_id) == F.col(who)) & (F.col(mark) == F.col(gone_mark)), "left_anti")
    same = Window.partitionBy(spot, doc_id, mark).orderBy(mark)
    kept = kept.withColumn(nth, F.row_number().over(same))
    return kept.where((F.col(nth) == 1) | F.col(doc_id).isNull()).drop(nth, mark, spot)


def query(spark, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")
