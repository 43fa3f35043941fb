"""LM scoring by subword lattice likelihood.

An existing unigram vocabulary gives the pieces and, by their scores, their first probabilities; one round of expected
counts over the words of the training documents refits these. A word's probability is the sum over all its segmentations
into pieces, by a forward recursion in log space. Besides, each word of the training documents is an arc of its own, with
its share of the tokens; the pieces have the rest, as much as there are distinct tokens to all (Witten and Bell's weight).
So what the model knows grows with the corpus. A text's probability is the product over its words and the end mark.

Documents are read once, into chunks of about CHUNK tokens: each holds its documents' words as numbers of the chunk's
own dictionary. Counts and probabilities are looked up for dictionaries, not for tokens, so hot words cost one row a
chunk, and the corpus' word table is never gathered on one machine.

Defined results: words are runs without ASCII white space, A-Z lower-cased; a null text is the empty one, which is its
end mark alone. A null id counts as the empty string when documents are held out. Repeated rows count each time and
return a row each. Characters that aren't pieces are spelled in bytes, so every text has a probability. Without any
training document the base score's counts are 0 and the vocabulary's own probabilities stand.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

CHUNK, PRIOR, SPACE = 1_500_000, 10_000.0, "▁"
_P = np.uint64(0x9E3779B97F4A7C15)


class Lattice:
    """Pieces with log probabilities; forward sums over all segmentations of words, and expected counts of pieces."""

    def __init__(self, pieces: list[str], logp: np.ndarray, special: dict[str, int]):
        self.pieces, self.logp = pieces, logp
        self.end = special["end"]
        self.bytes = special["bytes"]  # the number of the piece <0x00>; the others follow
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if k != self.end and not self.bytes <= k < self.bytes + 256 and SPACE not in p[1:] and p != "<unk>":
                by.setdefault(len(p), []).append(k)
        for n, ids in by.items():
            h = np.array([_hash([ord(c) for c in pieces[k]]) for k in ids], np.uint64)
            order = np.argsort(h)
            self.lengths[n] = (h[order], np.array(ids)[order])
        self.longest = max(self.lengths, default=1)

    @classmethod
    def load(cls, path: str) -> Lattice:
        """From a sentencepiece model: the probability of the piece with the n-th best score falls as 1/n."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.IdToPiece(i) for i in range(sp.GetPieceSize())]
        scores = np.array([sp.GetScore(i) for i in range(len(pieces))])
        usable = np.array([not (sp.IsControl(i) or sp.IsUnknown(i)) and scores[i] > -1e8 for i in range(len(pieces))])
        end, first = sp.eos_id(), sp.PieceToId("<0x00>")
        usable[end] = True
        plain = usable.copy()
        plain[first : first + 256], plain[end] = False, False
        weight = np.zeros(len(pieces))
        order = np.argsort(-scores[plain], kind="stable")
        weight[np.flatnonzero(plain)[order]] = 1 / np.arange(10, 10 + plain.sum())
        weight[first : first + 256] = weight[plain].min()
        weight[end] = weight.max()
        keep = np.flatnonzero(usable)
        back = {int(k): n for n, k in enumerate(keep)}
        return cls([pieces[k] for k in keep], np.log(weight[keep] / weight.sum()), {"end": back[end], "bytes": back[first]})

    def refitted(self, counts: np.ndarray, prior: float = PRIOR) -> Lattice:
        p = np.exp(self.logp)
        new = (counts + prior * p) / (counts.sum() + prior * p.sum())
        return Lattice(self.pieces, np.log(new), {"end": self.end, "bytes": self.bytes})

    def _blocks(self, words: list[bytes]):
        """Positions of words of one length, and their code points."""
        texts = [SPACE + w.decode("utf-8", "replace") for w in words]
        by: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            by.setdefault(len(t), []).append(k)
        for n, ks in by.items():
            step = max(1, 100_000 // n)
            for i in range(0, len(ks), step):
                part = ks[i : i + step]
                yield part, np.array([[ord(c) for c in texts[k]] for k in part], np.uint64)

    def _arcs(self, points: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: log probabilities and piece numbers of the pieces at each start; -1 where there's none."""
        arcs, h, n = {}, np.zeros_like(points), points.shape[1]
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * _P + points[:, size - 1 :]
            if size not in self.lengths:
                continue
            keys, ids = self.lengths[size]
            at = np.searchsorted(keys, h).clip(0, len(keys) - 1)
            piece = np.where(keys[at] == h, ids[at], -1)
            arcs[size] = (np.where(piece >= 0, self.logp[piece], -np.inf), piece)
        chars, which = np.unique(points, return_inverse=True)
        spelled = np.array([sum(self.logp[self.bytes + b] for b in chr(int(c)).encode("utf-8", "replace")) for c in chars])
        known = arcs.get(1, (np.full(points.shape, -np.inf), np.full(points.shape, -1)))
        arcs[1] = (np.logaddexp(known[0], spelled[which].reshape(points.shape)), known[1])
        return arcs

    @staticmethod
    def _forward(arcs, rows: int, n: int) -> np.ndarray:
        total = np.full((rows, n + 1), -np.inf)
        total[:, 0] = 0
        for i in range(1, n + 1):
            into = np.stack([total[:, i - s] + a[:, i - s] for s, (a, _) in arcs.items() if s <= i])
            top = into.max(axis=0)
            total[:, i] = top + np.log(np.exp(into - top).sum(axis=0))
        return total

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.zeros(len(words))
        with np.errstate(over="ignore"):
            for ks, points in self._blocks(words):
                out[ks] = self._forward(self._arcs(points), *points.shape)[:, -1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of words that occur so many times."""
        counts = np.zeros(len(self.pieces))
        with np.errstate(over="ignore"):
            for ks, points in self._blocks(words):
                arcs, (rows, n) = self._arcs(points), points.shape
                ahead = self._forward(arcs, rows, n)
                back = np.full((rows, n + 1), -np.inf)
                back[:, n] = 0
                for i in range(n - 1, -1, -1):
                    out = np.stack([a[:, i] + back[:, i + s] for s, (a, _) in arcs.items() if i + s <= n])
                    top = out.max(axis=0)
                    back[:, i] = top + np.log(np.exp(out - top).sum(axis=0))
                weight = np.log(times[ks])[:, None] - ahead[:, -1:]
                for s, (a, piece) in arcs.items():
                    share = np.exp(ahead[:, : n - s + 1] + a + back[:, s:] + weight)
                    known = piece >= 0
                    counts += np.bincount(piece[known], share[known], len(counts))
                    if s == 1:
                        for c, x in zip(points[~known], share[~known], strict=True):
                            for b in chr(int(c)).encode("utf-8", "replace"):
                                counts[self.bytes + b] += x
        return counts


def _hash(points: list[int]) -> int:
    h = 0
    for c in points:
        h = (h * int(_P) + c) % 2**64
    return h


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """docs: id, train, text (binary). A row for each chunk, see the module."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"chunk bigint, ids array<{kind}>, train array<boolean>, sizes binary, bags binary, words array<binary>, counts array<bigint>"

    def pack(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0

        def row(ids, train, bags, number, counts):
            flat = np.concatenate(bags) if bags else np.zeros(0, np.int64)
            steps = np.diff(flat, prepend=0).astype("<i4")
            sizes = np.array([len(b) for b in bags], "<i4")
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq]), pa.array([ids], pa.list_(id_type)), pa.array([train]), pa.array([sizes.tobytes()]), pa.array([zlib.compress(steps.tobytes(), 1)], pa.binary()),
                 pa.array([list(number)], pa.list_(pa.binary())), pa.array([counts[: len(number)]], pa.list_(pa.int64()))],
                ["chunk", "ids", "train", "sizes", "bags", "words", "counts"],
            )

        ids, train, bags, number, size = [], [], [], {}, 0
        counts = np.zeros(1 << 16, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for i, t, x in zip(batch["id"].to_pylist(), batch["train"].to_pylist(), batch["text"], strict=True):
                words = (x.as_py() or b"").lower().split()
                bag = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, len(words))
                bag.sort()
                while len(number) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(counts), np.int64)])
                if t:
                    np.add.at(counts, bag, 1)
                ids.append(i), train.append(t), bags.append(bag)
                size += len(words) + 1
                if size >= chunk:
                    yield row(ids, train, bags, number, counts)
                    ids, train, bags, number, size, seq = [], [], [], {}, 0, seq + 1
                    counts = np.zeros(1 << 16, np.int64)
        if ids:
            yield row(ids, train, bags, number, counts)

    return docs.mapInArrow(pack, schema)


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None, vocabulary: str | None = None, rounds: int = 1, chunk: int = CHUNK) -> DataFrame:
    """A row for each of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    held_out: which documents aren't learned from, by default every seventh by the CRC of the id. vocabulary: a
    sentencepiece model, at the same place on every machine.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "utf-8")) % 7 == 2
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(doc_id).alias("id"), (~held_out).alias("train"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text"))
    chunks = written(_chunks(rows, chunk), "chunks")
    entries = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("chunk", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    counted = written(entries.groupBy("word").agg(F.sum("c").alias("c")), "counts")
    ends = chunks.select(F.explode("train").alias("t")).agg(F.count_if("t").alias("n")).first()["n"]
    total = counted.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train, distinct = (total["n"] or 0) + ends, (total["v"] or 0) + (ends > 0)

    lattice = Lattice.load(vocabulary)
    for _ in range(rounds if n_train else 0):
        shared = spark.sparkContext.broadcast(lattice)

        def expect(batches, shared=shared):
            got = np.zeros(len(shared.value.pieces))
            for b in batches:
                got += shared.value.expected(b["word"].to_pylist(), np.array(b["c"].to_pylist(), float))
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["piece", "n"])

        sums = counted.where("c > 0").mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()  # at most a row for each piece
        counts = np.zeros(len(lattice.pieces))
        for r in sums:
            counts[r["piece"]] = r["n"]
        counts[lattice.end] += ends
        lattice = lattice.refitted(counts)
    shared = spark.sparkContext.broadcast(lattice)

    @F.arrow_udf("double")
    def word_score(words: pa.Array) -> pa.Array:
        return pa.array(shared.value.log_probabilities(words.to_pylist()) / math.log(10))

    # log10 of (c + distinct * p) / (n + distinct), with p from the pieces, which is too small for a double in long words.
    p, known = F.col("p"), counted.select("word", "c", word_score("word").alias("p"))
    if n_train:
        seen = F.log10((F.col("c") + distinct * F.pow(F.lit(10.0), p)) / (n_train + distinct))
        p = F.when(F.col("c") > 0, seen).otherwise(p + math.log10(distinct / (n_train + distinct)))
    known = known.select("word", "c", p.alias("s"))
    looked_up = entries.select("chunk", "at", "word").join(known, "word").select("chunk", "at", "c", "s")
    end_score = float(lattice.logp[lattice.end] / math.log(10))
    if n_train:
        end_score = math.log10((ends + distinct * 10**end_score) / (n_train + distinct))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left["words"][0].as_py()
        c, s = np.zeros(size + 1), np.zeros(size + 1)
        at = right["at"].to_numpy()
        c[at], s[at] = right["c"].to_numpy(), right["s"].to_numpy()
        c[size], s[size] = ends, end_score
        sizes = np.frombuffer(left["sizes"][0].as_py(), "<i4").astype(np.int64)
        bag = np.cumsum(np.frombuffer(zlib.decompress(left["bags"][0].as_py()), "<i4").astype(np.int64))
        of = np.repeat(np.arange(len(sizes)), sizes)
        base = np.log10((c + 1) / (n_train + 1 * (distinct + 1)))
        add = lambda x: np.bincount(of, x[bag], len(sizes)) + x[size]
        return pa.table({
            "id": left["ids"].combine_chunks().flatten() if len(left) else [], "held_out": pa.array([not t for t in left["train"][0].as_py()]), "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64)), "train_tokens": pa.array(np.full(len(sizes), n_train, np.int64)), "base_score": pa.array(add(base)), "score": pa.array(add(s)),
        })

    slim = chunks.select(F.col("chunk").alias("part"), "ids", "train", "sizes", "bags", F.size("words").alias("words"))
    out = slim.groupBy("part").cogroup(looked_up.groupBy("chunk")).applyInArrow(judge, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("id", doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"))
