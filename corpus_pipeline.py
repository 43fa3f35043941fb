"""A training corpus from documents: toxicity, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns each
document's token digests.

Defined results: a null or empty text is not toxic, no copy of anything, not contaminated, has no secrets and no tokens, so
its document stays. Rows without an id stay. Of rows with one id and one text one stays; of one id with two texts, each is
judged by itself. Other columns pass through up to the last stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import bpe, decontamination, near_dedup, secrets, toxicity
from tidewright.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is at least a half go."""
    at = fresh(docs, "toxic")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, chain, at).where(F.col(at)[len(chain.categories) - 1] < 0.5).drop(at)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    return near_dedup.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside benchmark windows go."""
    at = fresh(docs, "found")
    return decontamination.matched(docs, table(spark, sf_dir, "benchmark"), at).where(~decontamination.contaminated(at)).drop(at)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret becomes a mask, and n_chars, where there is one, follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and what they decode to, as digests."""
    at = fresh(docs, "coded")
    return bpe.digest(bpe.encoded(docs, at), at)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", mask_secrets),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: The classifier and the near-duplicate search can't be expressed in SQL; tests hold run() against plain Python.
ORACLE_SQL = None
