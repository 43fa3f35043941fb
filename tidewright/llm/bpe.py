"""BPE encoding and decoding with a given vocabulary file.

A word's symbols form a doubly linked list; a priority queue holds the ranks of the merges that neighbours allow, and
entries whose symbols have changed since are skipped. Decoding joins the vocabulary's strings.

The file's steps are followed: its special tokens are cut out first; then NFC, one blank for white space, lower case
by character, the split into words, and bytes as characters with the word-end mark on the last one. Since no word
crosses white space, results are kept by stretch between white space and by word, in bounded memory.

Defined results: a null text is encoded as the empty one, to no ids. Rows and other columns pass through one for one.
"""

from __future__ import annotations

import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCHES, WORDS = 100_000, 80_000
#: Texts whose ids a worker gathers before it hands them on.
AT_ONCE = 250
TYPE = "struct<ids: binary, text: string>"
#: As the tokenizers library's split step, on text whose white space never belongs to a word.
_SPACE = regex.compile(r"\p{White_Space}+")
#: Separators to str.split() that aren't white space to the tokenizer.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Recent:
    """What was computed lately for keys: at least the last `most` of them, at most twice as many."""

    def __init__(self, make, most: int):
        self.make, self.most, self.new, self.old = make, most, {}, {}

    def __call__(self, key: str) -> bytes:
        got = self.new.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None:
                got = self.make(key)
                if len(key) > 64:
                    return got
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[key] = got
        return got


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.token_bytes = [self.token.get(i, "").encode() for i in range(max(self.token) + 1)]
        chars = byte_characters()
        self.first = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = [vocab[a + b] for a, b in pairs]
        self.size = len(self.token_bytes)
        self.rank = {vocab[a] * self.size + vocab[b]: k for k, (a, b) in enumerate(pairs)}
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.lead = tuple({x[0] for x in self.special})
        #: Whether letters alone are one word to the split, as a few samples show.
        self.letters = all(self.split.findall(x) == [x] for x in ("a", "zq", "strengths"))
        self.word, self.stretch = Recent(self._word, WORDS), Recent(self._stretch, STRETCHES)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        ids = [self.first[b] for b in word]
        ids[-1] = self.last[word[-1]]
        n = len(ids)
        if n == 1:
            return ids
        # An entry is its rank and position in one number; a pair of symbols is one number as well.
        rank, made, size = self.rank.get, self.made, self.size
        queue = [r * n + i for i, r in enumerate([rank(a * size + b) for a, b in zip(ids, ids[1:], strict=False)]) if r is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            r, i = divmod(pop(queue), n)
            j = after[i]
            if j >= n or rank(ids[i] * size + ids[j]) != r:
                continue  # stale: one of the two has been merged meanwhile
            new = ids[i] = made[r]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new * size + ids[k])) is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank(ids[h] * size + new)) is not None:
                push(queue, r * n + h)
        return [x for x in ids if x >= 0]

    def _word(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case is taken by character, without the rule for final sigma
            text = text.replace("Σ", "σ")
        return b"".join([self.word(x) for x in self.split.findall(text.lower())])

    def _stretch(self, text: str) -> bytes:
        """The packed ids of a stretch without white space."""
        if self.letters and text.isascii() and text.isalpha():
            return self.word(text.lower())
        if self.cut is not None and any(x in text for x in self.lead):
            return b"".join([struct.pack("<I", self.special[x]) if x in self.special else self.plain(x) for x in self.cut.split(text) if x])
        return self.plain(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = _SPACE.split(text) if any(x in text for x in _ODD_SPACE) else text.split()
        known, stretch = self.stretch.new.get, self.stretch
        return b"".join([known(x) or stretch(x) for x in parts if x])

    def decode(self, ids: bytes) -> str:
        token = self.token_bytes
        return b" ".join([token[i] for i in memoryview(ids).cast("I")]).decode() if ids else ""


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, into: str, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with a struct column named into: ids, packed as little-endian unsigned 32-bit integers; text, what these
    ids decode to. path: the vocabulary file, at the same place on every machine."""
    path = path or default_vocabulary()

    @F.arrow_udf(TYPE)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            for i in range(0, max(len(texts), 1), AT_ONCE):
                ids = [bpe.encode(x.as_py()) for x in texts[i : i + AT_ONCE]]
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["ids", "text"])

    return docs.withColumn(into, code(F.col(text)))


def digest(docs: DataFrame, into: str) -> DataFrame:
    """What the query and the pipeline's last stage return of encoded()."""
    return docs.select(
        "doc_id", F.floor(F.length(f"{into}.ids") / 4).cast("bigint").alias("n_tokens"), F.sha2(f"{into}.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col(f"{into}.text"), "utf-8"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return digest(encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), "coded"), "coded")
