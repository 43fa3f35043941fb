"""Rule analytics of tracked observations: zone and line events, dwell, class consensus, track summaries.

Observations: track_id, class_name, t (ms), seq (order of arrival), conf, x, y, w, h, and any partition columns such as a
camera. Equal times are kept in order of seq. The buffer of unconfirmed tracks needs no state here: it is flushed whole
once a track has enough observations, so the events of tracks with that many are the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import center, in_polygon, side_of_line, valid_box
from ..functions.ids import OID, uuid5

NIL = "00000000-0000-0000-0000-000000000000"


@dataclass
class Zone:
    id: str
    points: list[tuple[float, float]]
    restricted: bool = False


@dataclass
class Line:
    id: str
    start: tuple[float, float]
    end: tuple[float, float]
    inbound: str = "inbound"
    outbound: str = "outbound"


@dataclass
class Policy:
    zones: list[Zone] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)
    confirmation: int = 3
    dwell_ms: int = 10_000


#: The built-in sample: zone, line and thresholds.
SAMPLE_POLICY = Policy([Zone("restricted-loading-area", [(0.64, 0.08), (0.96, 0.08), (0.96, 0.94), (0.64, 0.94)], True)], [Line("main-entry", (0.5, 0.0), (0.5, 1.0))], 3, 4000)


def validated(obs: DataFrame) -> DataFrame:
    """obs, failing on the first row with a blank id or class, a confidence outside 0..1, or a box outside the frame."""
    good = (F.trim("track_id") != "") & (F.trim("class_name") != "") & F.col("conf").between(0, 1) & ~F.isnan(F.col("conf").cast("double")) & valid_box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return obs.where(F.when(F.coalesce(good, F.lit(False)), True).otherwise(F.raise_error(F.lit("invalid observation")).cast("boolean")))


def _walked(obs: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """Each observation with its place against all zones and lines, what both were one observation before, and its track's
    totals: one shuffle by track, whatever the number of zones and lines."""
    px, py = center(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    inside = [_any([in_polygon(px, py, z.points) for z in zones]) for zones in _by_id(policy.zones).values()]
    sides = [side_of_line(px, py, ln.start, ln.end) for ln in policy.lines]
    arrays = {"inside": F.array(*inside).cast("array<boolean>"), "sides": F.array(*sides).cast("array<double>")}
    rows = obs.withColumns(arrays).select(*keys, "track_id", "class_name", "t", "seq", "conf", *arrays)
    track = Window.partitionBy(*keys, "track_id")
    order = track.orderBy("t", "seq")
    rows = rows.withColumns({
        "was_inside": F.lag("inside").over(order), "was_sides": F.lag("sides").over(order), "last": F.lead("seq").over(order).isNull(),
        "observations": F.count("*").over(track), "started_at_ms": F.min("t").over(track), "ended_at_ms": F.max("t").over(track), "maximum_confidence": F.max("conf").over(track),
        "ever": F.array(*[F.max(F.get("inside", F.lit(k))).over(track) for k in range(len(inside))]).cast("array<boolean>"), "classes": F.size(F.collect_set("class_name").over(track)),
    })
    rows = rows.where(F.col("observations") >= max(policy.confirmation, 1))
    weight = F.round(F.sum("conf").over(Window.partitionBy(*keys, "track_id", "class_name")), 9)
    return rows.withColumn("weight", weight).withColumn("final", F.first("class_name").over(track.orderBy(F.desc("weight"), "class_name"))).withColumn("duration_ms", F.col("ended_at_ms") - F.col("started_at_ms"))


def _by_id(parts: list) -> dict[str, list]:
    out: dict[str, list] = {}
    for p in parts:
        out.setdefault(p.id, []).append(p)
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _visited(policy: Policy) -> Column:
    ids = list(_by_id(policy.zones))
    return F.array_sort(F.array_compact(F.array(*[F.when(F.get("ever", F.lit(k)), F.lit(z)) for k, z in enumerate(ids)]).cast("array<string>")))


_EVENT = "array<struct<event_type:string,zone_id:string,line_id:string,direction:string,phase:int,line_ordinal:int>>"


def _found(policy: Policy) -> Column:
    """The events of one walked observation."""
    make = lambda kind, zone=None, line=None, direction=None, phase=0, ordinal=0: F.struct(F.lit(kind).alias("event_type") if isinstance(kind, str) else kind.alias("event_type"), F.lit(zone).cast("string").alias("zone_id"), F.lit(line).cast("string").alias("line_id"), (F.lit(None).cast("string") if direction is None else direction).alias("direction"), F.lit(phase).alias("phase"), F.lit(ordinal).alias("line_ordinal"))
    out = []
    for k, (zid, zones) in enumerate(_by_id(policy.zones).items()):
        now, was = F.get("inside", F.lit(k)), F.coalesce(F.get("was_inside", F.lit(k)), F.lit(False))
        entered = "restricted_zone_occupied" if zones[0].restricted else "object_entered_zone"
        out += [F.when(now & ~was, make(entered, zid)), F.when(~now & was, make("object_exited_zone", zid, phase=1))]
    ids = [ln.id for ln in policy.lines]
    for k, ln in enumerate(policy.lines):
        # Lines that share an id share the last side, also within one observation.
        earlier = [j for j in range(k) if ids[j] == ln.id]
        was = F.get("sides", F.lit(earlier[-1])) if earlier else F.get("was_sides", F.lit(max(j for j in range(len(ids)) if ids[j] == ln.id)))
        now = F.get("sides", F.lit(k))
        crossed = (F.abs(was) > 1e-4) & (F.abs(now) > 1e-4) & (F.signum(was) != F.signum(now))
        out.append(F.when(crossed, make("line_crossed", line=ln.id, direction=F.when(was > 0, ln.inbound).otherwise(ln.outbound), phase=2, ordinal=k)))
    dwelled = F.col("last") & (F.col("duration_ms") >= policy.dwell_ms)
    out.append(F.when(dwelled, make("dwell_threshold_exceeded", phase=3).withField("zone_id", F.get(_visited(policy), F.lit(0)))))
    return F.array_compact(F.array(*out)).cast(_EVENT)


def summaries(obs: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """Confirmed tracks: times, number of observations, best confidence, zones visited, consensus class (the largest sum of
    confidence, ties to the smaller name) and the number of classes."""
    rows = _walked(obs, policy, keys).where("last")
    last = {"last_conf": "conf", "last_seq": "seq"}
    return rows.select(*keys, "track_id", F.col("final").alias("class_name"), "classes", "started_at_ms", "ended_at_ms", "duration_ms", "observations", "maximum_confidence", _visited(policy).alias("zones_visited"), *[F.col(c).alias(n) for n, c in last.items()])


def events(obs: DataFrame, policy: Policy, keys: list[str], job: str = NIL) -> DataFrame:
    """All rule events of confirmed tracks, with content-derived ids, in `emit_ordinal` order within a partition."""
    rows = _walked(obs, policy, keys).withColumn("e", F.explode(_found(policy)))
    rows = rows.select(*keys, "track_id", F.col("final").alias("class_name"), "t", "seq", "conf", "duration_ms", "e.*")
    name = F.concat_ws(":", F.lit(job), "event_type", "track_id", F.col("t").cast("string"), F.coalesce("zone_id", F.lit("")), F.coalesce("line_id", F.lit("")))
    seconds = F.floor(F.col("duration_ms") / 1000).cast("string")
    rest = F.when(F.col("phase") == 0, F.concat(F.lit(" entered zone "), "zone_id")).when(F.col("phase") == 1, F.concat(F.lit(" exited zone "), "zone_id")).when(F.col("phase") == 2, F.concat(F.lit(" crossed line "), "line_id", F.lit(" in the "), "direction", F.lit(" direction"))).otherwise(F.concat(F.lit(" remained visible for "), seconds, F.lit(" seconds")))
    rows = rows.withColumn("event_id", uuid5(OID, name)).withColumn("description", F.concat("class_name", rest)).drop("duration_ms")
    window = Window.partitionBy(*keys, "track_id").orderBy("t", (F.col("phase") == 3), "seq", "phase", "zone_id", "line_ordinal")
    return rows.withColumn("emit_ordinal", F.row_number().over(window))


def prototype(obs: DataFrame, keys: list[str], vector: str = "appearance") -> DataFrame:
    """The confidence-weighted mean of a track's vectors, of the first one's length, scaled to length 1; null without."""
    first = F.min_by(F.size(vector), F.struct("t", "seq")).alias("dim")
    have = obs.where(F.col(vector).isNotNull())
    rows = have.join(have.groupBy(*keys, "track_id").agg(first), [*keys, "track_id"]).where((F.col("dim") > 0) & (F.size(vector) == F.col("dim")) & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    parts = rows.select(*keys, "track_id", F.greatest("conf", F.lit(0.05)).alias("weight"), F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "track_id", "pos").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
    whole = parts.groupBy(*keys, "track_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("all"))
    return whole.where("norm > 1.1920929e-07").select(*keys, "track_id", F.transform("all", lambda a: a["v"] / F.col("norm")).alias("prototype"))
