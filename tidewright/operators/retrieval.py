"""Lexical retrieval over record texts, rank fusion, vector search by sign bits, and claim checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, hamming, sign_bits

#: The stop words and the synonym groups.
STOP_WORDS = ["a", "an", "and", "are", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "this", "to", "was", "what", "when", "where", "with"]
SYNONYMS = [
    ["person", "people", "pedestrian", "worker", "human"],
    ["car", "vehicle", "truck", "van", "automobile"],
    ["ship", "boat", "vessel"],
    ["outside", "outdoor", "exterior"],
    ["road", "street", "roadway"],
    ["move", "moving", "movement", "motion", "activity"],
    ["scrap", "scrapyard", "junkyard"],
]


def terms(text: Column) -> Column:
    """Distinct lower-case terms of more than one byte that aren't stop words."""
    parts = F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.octet_length(t) > 1) & ~t.isin(STOP_WORDS)))


def expanded(terms_: list[str]) -> list[str]:
    out = set(terms_)
    for t in terms_:
        out |= set(next((g for g in SYNONYMS if t in g), ()))
    return sorted(out)


def matched(text: Column, asked: list[str]) -> Column:
    """The asked terms among a text's; texts that hold none even as a part of a word aren't split."""
    some = F.array_intersect(terms(text), F.array(*map(F.lit, asked)))
    may = F.lower(text).rlike("|".join(re.escape(t) for t in asked)) if asked else F.lit(False)
    return F.when(may, some).otherwise(F.array().cast("array<string>"))


def document_frequency(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lexical(docs: DataFrame, doc_id: str, text: str, query: list[str], limit: int = 50) -> DataFrame:
    """The best documents by the inverse document frequencies of the matched query terms; ties by id. The number of
    documents and of those with each asked term come from one pass; they stand in the scoring expression of the second."""
    asked = expanded(query)
    rows = docs.select(doc_id, matched(F.col(text), asked).alias("hits"))
    n = rows.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("hits", t)).alias(f"n{k}") for k, t in enumerate(asked)]).first()
    idf = F.create_map(*[x for k, t in enumerate(asked) for x in (F.lit(t), F.log(F.lit((max(n["n"], 1) + 1.0) / (n[f"n{k}"] + 1))) + 1)])
    score = F.round(F.aggregate("hits", F.lit(0.0), lambda s, t: s + idf[t]) / len(asked), 6)
    return rows.where(F.size("hits") > 0).select(doc_id, score.alias("score")).orderBy(F.desc("score"), doc_id).limit(min(max(limit, 1), 50))


def fused(rankings: DataFrame, item: str, limit: int, k: int = 60) -> DataFrame:
    """item, score: the sum of 1 / (k + rank) over rankings. rankings: item, ranking, rank; an item counts once in each."""
    first = rankings.groupBy(item, "ranking").agg(F.min("rank").alias("rank"))
    return first.groupBy(item).agg(F.sum(1 / (k + F.col("rank"))).alias("score")).orderBy(F.desc("score"), item).limit(limit)


def nearest_by_signs(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], k: int = 10, oversample: float = 2.5) -> DataFrame:
    """The k best by cosine of a shortlist of the nearest sign-bit codes; ties by id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    short = vectors.select(vec_id, embedding, hamming(sign_bits(F.col(embedding)), sign_bits(q)).alias("hamming")).orderBy("hamming", vec_id).limit(max(k, -(-int(k * oversample * 1000) // 1000)))
    return short.select(vec_id, "hamming", F.round(cosine(F.col(embedding), q), 6).alias("cosine")).orderBy(F.desc("cosine"), vec_id).limit(k)


def nearest(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], k: int = 10) -> DataFrame:
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.select(vec_id, F.round(cosine(F.col(embedding), q), 6).alias("cosine")).orderBy(F.desc("cosine"), vec_id).limit(k)


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def grounded(claim: Column, facts: Column) -> Column:
    """Whether every number of the claim occurs among the facts' numbers."""
    return F.size(F.array_except(numbers(claim), numbers(facts))) == 0


def unfenced(text: Column) -> Column:
    """The body of a fenced JSON answer, or the trimmed text."""
    body = F.regexp_extract(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(body != "", body).otherwise(F.trim(text))


#: The states of each family, in order, and what a change from one to the next is called, up and down.
STATES = {
    "door_openness": ["closed", "ajar", "open", "unclear"],
    "support_relation": ["off_reference", "on_reference", "unclear"],
    "region_membership": ["outside", "inside", "unclear"],
    "camera_distance": ["far", "middle", "near", "unclear"],
}
MOVES = {"door_openness": ("opening", "closing"), "support_relation": ("placing", "removing"), "region_membership": ("arriving", "leaving"), "camera_distance": ("approaching", "receding")}


def transition(family: str, before: Column, after: Column) -> Column:
    """The move between two states; null if unclear or unchanged. A state that the family doesn't have is an error."""
    order = F.array(*map(F.lit, STATES[family]))
    up, down = MOVES[family]
    a, b = F.array_position(order, before), F.array_position(order, after)
    known = (a > 0) & (b > 0)
    moved = F.when((before == "unclear") | (after == "unclear") | (a == b), None).when(b > a, up).otherwise(down)
    return F.when(F.coalesce(known, F.lit(False)), moved).otherwise(F.raise_error(F.concat(F.lit(f"unknown state of {family}: "), F.coalesce(before, F.lit("null")), F.lit(" or "), F.coalesce(after, F.lit("null")))).cast("string"))


def state_gate(family: str, before: Column, after: Column, identity: Column, reference_visible: Column, claimed: Column, area_ratio: Column, least_change: float = 0.15) -> Column:
    """passed or rejected: a claim stands if the same target was seen beside a visible reference, its states moved as claimed
    and, for a distance, its box grew or shrank enough. area_ratio is null where there is no box."""
    move = transition(family, before, after)
    sound = (identity == "same") & reference_visible & (move == claimed)
    if family == "camera_distance":
        small = ((move == "approaching") & (area_ratio < 1 + least_change)) | ((move == "receding") & (area_ratio > 1 / (1 + least_change)))
        sound = sound & ~F.coalesce(small | F.isnan(area_ratio), F.lit(False))
    return F.when(F.coalesce(sound, F.lit(False)), "passed").otherwise("rejected")


def scene_graph(triplets: Column, horizon_ms: int = 3000) -> tuple[Column, Column]:
    """transitions and hazards of an array of struct subject, relationship, object: those that push or strike."""
    rough = F.filter(triplets, lambda t: F.contains(t["relationship"], F.lit("push")) | F.contains(t["relationship"], F.lit("strike")))
    moves = F.transform(rough, lambda t: F.struct(F.concat(t["subject"], F.lit(" approaching "), t["object"]).alias("from_state"), F.concat_ws(" ", t["subject"], t["relationship"], t["object"]).alias("to_state"), F.lit(400).alias("delta_ms"), F.lit(0.88).alias("score")))
    hazards = F.transform(rough, lambda t: F.concat(F.lit(f"Physical altercation anticipated within {horizon_ms}ms between "), t["subject"], F.lit(" and "), t["object"]))
    return moves, hazards


def interpretation_window(start: Column, end: Column, duration: Column, margin: int = 2000, most: int = 20_000) -> tuple[Column, Column]:
    lo = F.greatest(start - margin, F.lit(0))
    return lo, F.least(end + margin, F.greatest(duration, end), lo + most)


def midpoints(start: Column, end: Column, n: int) -> Column:
    """The middles of n equal parts of an interval."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (i + 0.5) / n * (end - start))


def grouped_decode(targets: Column, end: Column, size: int, most: int = 32, span_ms: int = 20_000, most_bytes: int = 32 << 20) -> Column:
    """Whether frames at some times may be decoded in one run."""
    n = F.size(targets)
    span = end - F.array_min(targets)
    return n.between(2, most) & (span > 0) & (span <= span_ms) & (n * (size * size * 8 + 65536) <= most_bytes)
