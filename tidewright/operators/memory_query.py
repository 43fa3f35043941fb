"""Questions to indexed clips: filters, lexical scores with priors, ranks, and the texts around them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import expanded, matched

SCALARS = ("camera", "country", "country_code", "region", "city", "manufacturer", "about", "summary", "scene_type", "conditions")
LISTS = ("visible_objects", "visible_people", "apparent_actions", "visible_text")


@dataclass
class Request:
    query: list[str]
    limit: int = 10
    job: int | None = None
    cluster: str | None = None
    cameras: list[str] = field(default_factory=list)
    sessions: list[str] = field(default_factory=list)
    start_ms: int | None = None
    end_ms: int | None = None


def eligible(clips: DataFrame, r: Request) -> DataFrame:
    """What a request's filters let pass; a filter that isn't given passes all, a null never equals a given value."""
    out = clips
    for asked, condition in (
        (r.job is not None, F.col("job") == r.job), (r.cluster is not None, F.col("cluster") == r.cluster), (r.cameras, F.col("camera").isin(r.cameras)), (r.sessions, F.col("session").isin(r.sessions)),
        (r.start_ms is not None, F.col("end_ms") >= r.start_ms), (r.end_ms is not None, F.col("start_ms") <= r.end_ms),
    ):
        out = out.where(condition) if asked else out
    return out


def owning(clips: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Clips of the cameras that own an entity in the same session and job. entities: entity_id, camera, session, job."""
    own = entities.where(F.col("entity_id") == entity).select(F.col("camera").alias("c"), F.col("session").alias("s"), F.col("job").alias("j")).distinct()
    return clips.join(own, (F.col("camera") == F.col("c")) & F.col("session").eqNullSafe(F.col("s")) & (F.col("job") == F.col("j")), "left_semi")


def document(clips: DataFrame) -> Column:
    """A clip's text: its camera's and its description's fields, then its lists; fields that aren't there are left out."""
    have = set(clips.columns)
    return F.concat_ws(" ", *[F.col(c) for c in SCALARS if c in have], *[F.array_join(c, " ") for c in LISTS if c in have])


def retrieved(clips: DataFrame, r: Request, clip_id: str = "event_id") -> DataFrame:
    """rank, the clip's id, score and matched terms. The collection's numbers, one for each asked term, are gathered in a
    pass of their own and stand in the scoring expression; nothing is shuffled but the best."""
    asked = expanded(r.query)
    own = eligible(clips, r)
    rows = own.select(clip_id, "start_ms", "generated", "activity_peak", "quality", F.array_sort(matched(document(own), asked)).alias("matched"))
    n = rows.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("matched", t)).alias(f"n{k}") for k, t in enumerate(asked)]).first()
    idf = F.create_map(*[x for k, t in enumerate(asked) for x in (F.lit(t), F.log(F.lit((max(n["n"], 1) + 1.0) / (n[f"n{k}"] + 1))) + 1)])
    lexical = F.aggregate("matched", F.lit(0.0), lambda s, t: s + idf[t]) / max(len(asked), 1)
    score = lexical + F.when(F.col("generated"), 0.04).otherwise(0.0) + 0.03 * F.col("activity_peak") + 0.02 * F.col("quality")
    best = rows.where(F.size("matched") > 0).withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "start_ms", clip_id).limit(min(max(r.limit, 1), 50))
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "start_ms", clip_id)).alias("rank"), clip_id, "score", F.array_join("matched", ",").alias("matched"))


def reordered(found: DataFrame, relevant: list, clip_id: str = "event_id") -> DataFrame:
    """Ranks anew: ids named as relevant first, in the order given, then the others by score."""
    place = F.array_position(F.array(*map(F.lit, relevant)), F.col(clip_id)) if relevant else F.lit(0)
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.when(place == 0, len(relevant) + 1).otherwise(place), F.desc("score"), "rank")))


def reranked(found: DataFrame, clip_id: str = "event_id", score: str = "rerank", fused: str = "score") -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.desc(fused), clip_id)))


def snapshot(clips: DataFrame, r: Request, entities: DataFrame | None = None, entity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The eligible clips, and one row with how many are indexed in the entity's scope before any other filter."""
    scoped = owning(clips, entities, entity) if entity is not None else clips
    return eligible(scoped, r), scoped.agg(F.count("*").alias("indexed"))


def source_label(uri: Column) -> Column:
    out = F.lit("<local-video>")
    for scheme in ("rtsp://", "rtsps://", "http://", "https://"):
        out = F.when(F.startswith(uri, F.lit(scheme)), f"{scheme}***").otherwise(out)
    return out


def shortened(text: Column, most: int = 420) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def fallback_description(about: Column, places: list[Column], peak: Column) -> Column:
    """What stands for a description that no model wrote."""
    known = F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in places]), lambda p: F.trim(p) != ""), ", ")
    supplied = F.when(F.trim(F.coalesce(about, F.lit(""))) == "", "No backend scene description was supplied.").otherwise(F.concat(F.lit("Backend metadata describes this camera as: "), F.trim(about), F.lit(".")))
    place = F.when(known == "", "").otherwise(F.concat(F.lit(" Location metadata: "), known, F.lit(".")))
    tail = F.format_string(" The lightweight observer recorded an activity peak of %.2f; inspect the linked evidence for visual confirmation.", peak.cast("double"))
    return F.concat(supplied, place, tail)


def projection_key(camera: Column, session: Column) -> Column:
    return F.when(session.isNull(), camera).otherwise(F.to_json(F.array(camera, session)))


def clip_id(job: Column, camera: Column, session: Column, start: Column, end: Column) -> Column:
    """The content-derived id of a clip, in the namespace of its job."""
    from ..functions.ids import uuid5

    plain = F.concat_ws(":", camera, start.cast("string"), end.cast("string"))
    parts = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(F.to_json(F.array(camera, session)), r"^\[", ""), r"\]$", ""), F.lit(","), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]"))
    return uuid5(job, F.when(session.isNull(), plain).otherwise(parts))
