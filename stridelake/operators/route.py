"""Route analytics: GPS points, elevation profile, climb detection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import FEET_PER_METRE, METRES_PER_MILE, degrees, exact, feet, miles, mph, rint, rnd
from ..functions.timekeys import seconds_between
from ..session import cut_lineage, shuffle_width
from . import series
from .series import ACTIVITY

# Smoothing windows and climb thresholds.
SMOOTH_POINTS = 20
INSTANT_POINTS = 5
POWER_POINTS = 30
MIN_GRADE = 3.0
MIN_DISTANCE_M = 400.0
MIN_GAIN_M = 30.0
MERGE_GAP_M = 1609.0
MERGE_DROP_SHARE = 0.3


def route_points(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Points with a position, in order, in degrees, feet and mph; ``seq`` counts from 0."""
    order = order or ["timestamp"]
    measures = [c for c in ("power", "enhanced_altitude", "enhanced_speed", "heart_rate") if c in records.columns]
    located = records.filter(F.col("position_lat").isNotNull()).select(
        *ACTIVITY, *order, "position_lat", "position_long", *measures
    )
    numbered = series.number_rows(located, ACTIVITY, order, series.hour_bucket(order[0]))
    out = [
        *ACTIVITY, "seq",
        degrees(F.col("position_lat")).alias("lat"), degrees(F.col("position_long")).alias("lon"),
    ]
    if "power" in measures:
        out.append(F.coalesce("power", F.lit(0.0)).alias("power"))
    if "enhanced_altitude" in measures:
        out += [F.col("enhanced_altitude").alias("elevation_m"), feet(F.col("enhanced_altitude")).alias("elevation_ft")]
    if "enhanced_speed" in measures:
        out.append(mph(F.col("enhanced_speed")).alias("speed_mph"))
    if "heart_rate" in measures:
        out.append("heart_rate")
    return numbered.select(*out)


def route_centre(points: DataFrame) -> DataFrame:
    """Mean position and the first and last point of every route."""
    place = F.struct("lat", "lon")
    found = points.groupBy(*ACTIVITY).agg(
        F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"),
        F.min_by(place, "seq").alias("_a"), F.max_by(place, "seq").alias("_z"),
        F.count(F.lit(1)).alias("points"),
    )
    return found.select(
        *ACTIVITY, "centre_lat", "centre_lon",
        F.col("_a.lat").alias("start_lat"), F.col("_a.lon").alias("start_lon"),
        F.col("_z.lat").alias("end_lat"), F.col("_z.lon").alias("end_lon"), "points",
    )


def _profile(records: DataFrame, order: list[str], extra: list[str], halo: int = SMOOTH_POINTS + 1) -> DataFrame:
    """Filled distance and altitude with both grades; ``seq`` counts kept points from 0.

    Leading points without a distance or altitude are the only ones dropped, so the
    position among kept points is the raw position minus the first kept one.
    """
    thin = records.select(*ACTIVITY, *order, "distance", "enhanced_altitude", *extra)
    numbered = series.number_rows(thin, ACTIVITY, order, series.hour_bucket(order[0]), "_raw")
    filled = series.fill_forward(numbered, ACTIVITY, ["distance", "enhanced_altitude"], "_raw")
    kept = (
        filled.filter((F.col("_raw") >= F.col("lead")) & (F.col("rows") - F.col("lead") >= 2))
        .withColumn("seq", F.col("_raw") - F.col("lead"))
        .withColumn("last", F.col("_raw") == F.col("rows") - 1)
        .drop("_raw", "rows", "lead")
    )
    parts = series.chunked(kept, halo)
    w = series.chunk_window(ACTIVITY)
    rise = F.col("enhanced_altitude") - F.lag("enhanced_altitude").over(w)
    run = F.col("distance") - F.lag("distance").over(w)
    point_grade = F.coalesce(F.when(run > 0, rise / run * 100), F.lit(0.0))
    graded = parts.withColumn("_g", point_grade)
    return graded.select(
        *ACTIVITY, "seq", "chunk", "own", "last", *order, *extra,
        F.col("distance").alias("dist_m"), F.col("enhanced_altitude").alias("alt_m"),
        F.avg("_g").over(series.trailing(ACTIVITY, SMOOTH_POINTS)).alias("grade"),
        F.avg("_g").over(series.trailing(ACTIVITY, INSTANT_POINTS)).alias("instant"),
    )


def elevation_profile(records: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Distance, altitude, smoothed and near-instant grade and their difference per point."""
    points = _profile(records, order or ["timestamp"], []).filter("own")
    return points.select(
        *ACTIVITY, "seq",
        miles(F.col("dist_m")).alias("distance_mi"), feet(F.col("alt_m")).alias("altitude_ft"),
        F.col("grade").alias("grade_pct"), F.col("instant").alias("grade_instant"),
        rnd(F.col("instant") - F.col("grade"), 1).alias("grade_delta"),
    )


def graded_route(points: DataFrame, profile: DataFrame) -> DataFrame:
    """Route points with the profile's grade at the same position; 0 past its end."""
    grade = profile.select(*ACTIVITY, "seq", "grade_pct")
    return points.join(grade, [*ACTIVITY, "seq"], "left").withColumn(
        "grade_pct", F.coalesce("grade_pct", F.lit(0.0))
    )


def climb_spans(records: DataFrame, order: list[str] | None = None, min_grade: float = MIN_GRADE) -> DataFrame:
    """Maximal runs of points whose smoothed grade is at least ``min_grade``, each with the gap before it.

    One pass over the profile: inside a chunk points add up to spans, alternately steep and not, and a chunk's spans
    become one row. A table of one row per chunk tells which first spans go on from the chunk before and numbers the rest;
    parts of a span then merge, as all its sums do. Columns: ``segment``, and for the steep span ``seg`` and the gap
    ``gap`` (null at the start of a route) structs of the ends, the point before and the sums of ``_SUMS``.
    """
    order = order or ["timestamp"]
    points = _profile(records, order, ["power", "cadence"], max(SMOOTH_POINTS + 1, POWER_POINTS))
    w = series.chunk_window(ACTIVITY)
    here = F.struct("seq", "dist_m", "alt_m", *order)
    watts, turns = (F.coalesce(c, F.lit(0.0)).cast("bigint") for c in ("power", "cadence"))
    # whole-watt running sum: the 30-point mean is one subtraction
    summed = points.withColumn("p", watts).withColumn("_c", F.sum("p").over(w)).withColumn("_steep", F.coalesce(F.col("grade") >= min_grade, F.lit(False)))
    mean = (F.col("_c") - F.coalesce(F.lag("_c", POWER_POINTS).over(w), F.lit(0))) / POWER_POINTS
    marked = summed.select(
        *ACTIVITY, "seq", "chunk", "own", "instant", "p", turns.alias("cad"), "_steep", here.alias("at"),
        F.pow(mean, F.lit(4)).alias("p4"), F.lag("_steep").over(w).alias("_was"), F.lag(here).over(w).alias("before"),
    ).filter("own")
    # a chunk's first point always begins a part; whether it goes on from the chunk before is settled below
    edge = F.col("_was").isNull() | (F.col("_was") != F.col("_steep")) | (F.col("seq") == F.col("chunk") * F.lit(series.CHUNK_ROWS))
    local = marked.withColumn("_edge", edge).withColumn("_k", F.sum(F.col("_edge").cast("int")).over(w)).withColumn(
        "_from", F.max(F.when(F.col("_edge"), F.col("seq"))).over(w))
    early = F.col("seq") - F.col("_from") < POWER_POINTS - 1
    parts = local.groupBy(*ACTIVITY, "chunk", "_k").agg(
        F.first("_steep").alias("steep"), F.min("at").alias("a"), F.max("at").alias("z"), F.min_by("before", "seq").alias("before"),
        F.count(F.lit(1)).alias("n"), F.max("instant").alias("instant"),
        F.sum(F.when(F.col("p") > 0, F.col("p"))).alias("p"), F.count(F.when(F.col("p") > 0, 1)).alias("p_n"),
        F.sum(F.when(F.col("cad") > 0, F.col("cad"))).alias("cad"), F.count(F.when(F.col("cad") > 0, 1)).alias("cad_n"),
        # the first points of a climb do not count; which span begins one is not known yet
        F.transform(F.sort_array(F.collect_list(F.when(early, F.struct("seq", "p4")))), lambda x: x["p4"]).alias("head"),
        F.coalesce(F.sum(F.when(~early, F.col("p4"))), F.lit(0.0)).alias("tail"),
    )
    fields = [c for c in parts.columns if c not in (*ACTIVITY, "chunk", "_k")]
    # dealt by another key than the windows' one, else the exchange that both uses below share would be planned away
    packed = (parts.groupBy(*ACTIVITY, "chunk").agg(F.sort_array(F.collect_list(F.struct("_k", F.struct(*fields).alias("v")))).alias("spans"))
              .repartition(shuffle_width(records), F.xxhash64(*ACTIVITY, "chunk")))
    along = Window.partitionBy(*ACTIVITY).orderBy("chunk")
    ends = packed.select(*ACTIVITY, "chunk", F.size("spans").alias("m"), F.col("spans")[0]["v"]["steep"].alias("first"),
                         F.element_at("spans", -1)["v"]["steep"].alias("last"))
    known = ends.withColumn("_on", F.coalesce(F.lag("last").over(along) == F.col("first"), F.lit(False)).cast("int"))
    carry = known.select(
        *ACTIVITY, "chunk", "_on", F.first("first").over(along).cast("int").alias("_lead"),
        F.coalesce(F.sum(F.col("m") - F.col("_on")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    flat = packed.join(carry, [*ACTIVITY, "chunk"]).select(
        *ACTIVITY, "_lead", (F.col("_base") - F.col("_on")).alias("_base"), "chunk", F.posexplode_outer("spans").alias("_pos", "s"))
    # (the outer generator keeps both uses of the exchange alike: an inner one adds a filter to its own)
    # spans alternate, so a gap and the steep span after it share a number
    numbered = flat.withColumn("segment", F.floor((F.col("_base") + F.col("_pos") + F.col("_lead")) / 2))
    merged = numbered.groupBy(*ACTIVITY, "segment").agg(*[_joined(F.col("s.v.steep") == flag).alias(name) for name, flag in (("gap", False), ("seg", True))])
    return merged.filter(F.col("seg.n").isNotNull())


_SUMS = ["n", "instant", "p", "p_n", "cad", "cad_n", "head", "tail"]


def _joined(mine: Column) -> Column:
    """One span from its parts in the chunks it crosses."""
    v = F.when(mine, F.col("s.v"))
    heads = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(mine, F.struct("chunk", F.col("s.v.head").alias("h"))))), lambda x: x["h"]))
    later = F.aggregate(F.slice(heads, POWER_POINTS, F.lit(1 << 30)), F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(
        F.min(v["a"]).alias("a"), F.max(v["z"]).alias("z"), F.min_by(v["before"], v["a"]).alias("before"), F.sum(v["n"]).alias("n"),
        F.max(v["instant"]).alias("instant"), F.sum(v["p"]).alias("p"), F.sum(v["p_n"]).alias("p_n"), F.sum(v["cad"]).alias("cad"),
        F.sum(v["cad_n"]).alias("cad_n"), F.slice(heads, 1, POWER_POINTS - 1).alias("head"), (F.sum(v["tail"]) + later).alias("tail"))


def climb_segments(records: DataFrame, order: list[str] | None = None,
                   min_grade: float = MIN_GRADE) -> DataFrame:
    """Maximal runs of points whose smoothed grade is at least ``min_grade``."""
    return _segment_ends(climb_spans(records, order, min_grade), (order or ["timestamp"])[0])


def _segment_ends(spans: DataFrame, ts: str, *more: Column) -> DataFrame:
    return spans.select(
        *ACTIVITY, "segment",
        F.col("seg.a.seq").alias("start_seq"), F.col("seg.z.seq").alias("end_seq"),
        F.col("seg.a.dist_m").alias("start_m"), F.col("seg.z.dist_m").alias("end_m"),
        F.col("seg.a.alt_m").alias("start_alt_m"), F.col("seg.z.alt_m").alias("end_alt_m"),
        F.col(f"seg.a.{ts}").alias("start_ts"), F.col(f"seg.z.{ts}").alias("end_ts"), *more,
    )


def merge_segments(segments: DataFrame) -> DataFrame:
    """Join neighbouring segments that belong to one climb.

    A segment joins the (already merged) one before it when the gap is under
    ``MERGE_GAP_M`` and the drop in it is under 30 % of what was gained so far, or nothing
    was gained. A wider gap always separates, whatever came before, so the sequential
    merge runs separately between wide gaps, in parallel.

    With ``prev_end_m`` and the sums of segments (``seg``) and of the gaps before them (``gap``) the climbs' sums come along.
    """
    linked = segments
    if "prev_end_m" not in segments.columns:
        # neighbours meet by their running number: an equi join, not a window per activity
        prior = segments.select(*ACTIVITY, (F.col("segment") + 1).alias("segment"), F.col("end_m").alias("prev_end_m"))
        linked = segments.join(prior, [*ACTIVITY, "segment"], "left")
    wide = F.col("prev_end_m").isNull() | (F.col("start_m") - F.col("prev_end_m") >= MERGE_GAP_M)
    starts = linked.withColumn("_wide", wide)
    heads = series.chunked(starts, 0, "segment")
    w = series.chunk_window(ACTIVITY, "segment")
    within = F.max(F.when(F.col("_wide"), F.col("segment"))).over(w)
    known = heads.groupBy(*ACTIVITY, "chunk").agg(F.max(F.when(F.col("_wide"), F.col("segment"))).alias("_last"))
    earlier = series.before_chunk(ACTIVITY)
    carry = known.select(*ACTIVITY, "chunk", F.max("_last").over(earlier).alias("_in"))
    runs = heads.withColumn("_w", within).join(carry, [*ACTIVITY, "chunk"]).withColumn("run", F.coalesce("_w", "_in"))
    fields = ["start_seq", "end_seq", "start_m", "end_m", "start_alt_m", "end_alt_m", "start_ts", "end_ts"]
    rows = runs.select(*ACTIVITY, "run", "segment", *fields, *[c for c in ("seg", "gap") if c in runs.columns])
    # a run's segments pass in order through one task, which holds the climb that is still open
    placed = rows.repartition(shuffle_width(segments), *ACTIVITY, "run").sortWithinPartitions(*ACTIVITY, "run", "segment")
    return placed.mapInArrow(_merge_runs, rows.schema).drop("run", "gap")


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over sorted segments: each grows the open climb of its run or begins the next."""
    top, schema = None, None
    for batch in batches:
        done, schema = [], batch.schema
        for seg in batch.to_pylist():
            same = top is not None and all(top[k] == seg[k] for k in (*ACTIVITY, "run"))
            if same and _joins(top, seg):
                top |= {k: v for k, v in seg.items() if k.startswith("end")}
                for span in (seg.get("gap"), seg.get("seg")):
                    if span and span["n"]:
                        _absorb(top["seg"], span)
                continue
            if top is not None:
                done.append(top)
            top = seg
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if top is not None:
        yield pa.RecordBatch.from_pylist([top], schema=schema)


def _absorb(climb: dict, span: dict) -> None:
    """Add a span's sums to a climb's; the climb's first points stay out of its mean fourth power."""
    missing = max(0, POWER_POINTS - 1 - climb["n"])
    climb["tail"] += span["tail"] + sum(span["head"][missing:])
    climb["n"] += span["n"]
    climb["instant"] = max((x for x in (climb["instant"], span["instant"]) if x is not None), default=None)
    for k in ("p", "p_n", "cad", "cad_n"):
        climb[k] = (climb[k] or 0) + (span[k] or 0)


def _joins(top: dict, seg: dict) -> bool:
    """A condition on a missing value does not hold."""
    low, high, start = top["start_alt_m"], top["end_alt_m"], seg["start_alt_m"]
    if None in (top["end_m"], seg["start_m"], low, high) or seg["start_m"] - top["end_m"] >= MERGE_GAP_M:
        return False
    return high - low <= 0 or start is not None and high - start < (high - low) * MERGE_DROP_SHARE


def climbs(records: DataFrame, order: list[str] | None = None, min_grade: float = MIN_GRADE,
           min_distance_m: float = MIN_DISTANCE_M, min_gain_m: float = MIN_GAIN_M) -> DataFrame:
    """Sustained climbs with grade, climbing rate, power and cadence; ``climb_no`` along the route.

    Sums of the points travel with the spans that climbs are merged from, so the points are passed once.
    """
    order = order or ["timestamp"]
    sums = [F.struct(*[F.col(f"{k}.{c}") for c in _SUMS]).alias(k) for k in ("seg", "gap")]
    spans = climb_spans(records, order, min_grade)
    # one row for each steep stretch, which the runs, the merge and the numbering all read
    segments = cut_lineage(_segment_ends(spans, order[0], F.col("gap.before.dist_m").alias("prev_end_m"), *sums))
    merged = merge_segments(segments).filter(
        (F.col("end_m") - F.col("start_m") >= min_distance_m)
        & (F.col("end_alt_m") - F.col("start_alt_m") >= min_gain_m)
    )
    # climbs of one activity are far apart by construction (>= 400 m each): a short list
    numbered = series.number_rows(merged, ACTIVITY, ["start_seq"], series.chunk_of(F.col("start_seq")), "_k")
    distance = F.col("end_m") - F.col("start_m")
    gain = F.col("end_alt_m") - F.col("start_alt_m")
    seconds = seconds_between(F.col("start_ts"), F.col("end_ts"))
    power = rint(F.try_divide("seg.p", "seg.p_n"))
    counted = F.col("seg.n") - (POWER_POINTS - 1)
    fourth = F.when(counted > 0, rint(F.pow(F.col("seg.tail") / counted, F.lit(0.25))))
    return numbered.select(
        *ACTIVITY, (F.col("_k") + 1).alias("climb_no"), "start_seq", "end_seq",
        exact(F.col("start_m") / METRES_PER_MILE, 2).alias("start_mi"),
        exact(F.col("end_m") / METRES_PER_MILE, 2).alias("end_mi"),
        exact(distance / METRES_PER_MILE, 2).alias("distance_mi"),
        rint(gain * FEET_PER_METRE).alias("elevation_gain_ft"),
        exact(F.when(distance > 0, gain / distance * 100).otherwise(0.0), 1).alias("avg_grade"),
        exact(F.col("seg.instant"), 1).alias("max_grade"),
        F.when(seconds > 0, F.floor(seconds).cast("bigint")).alias("duration_s"),
        F.when(seconds > 0, rint(gain / (seconds / 3600))).alias("vam"),
        power.alias("avg_power"), F.when(power.isNotNull(), fourth).alias("normalized_power"),
        rint(F.try_divide("seg.cad", "seg.cad_n")).alias("avg_cadence"),
    )


def nearest_places(marks: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """``marks`` (keys, at_mi, ...) with ``seq`` of the place (keys, distance_mi, seq) nearest in distance, the first on a tie.

    Marks and places are sorted together within a mile of a route; a mark takes the last place up to it and the first from
    it on. Where its mile has none on a side, a table of one row per mile hands over the nearest mile's outermost
    one, however far. So gaps of any length and marks anywhere cost one sort each way.
    """
    mile = F.floor("mi")
    other = [c for c in marks.columns if c not in (*keys, "at_mi")]
    place = F.struct(F.col("distance_mi").alias("mi"), "seq")
    spots = (places.filter(F.col("distance_mi").isNotNull()).groupBy(*keys, "distance_mi").agg(F.min("seq").alias("seq"))
             .select(*keys, F.col("distance_mi").alias("mi"), place.alias("place")))
    asked = marks.filter(F.col("at_mi").isNotNull()).select(*keys, F.col("at_mi").alias("mi"), F.struct(*other, "at_mi").alias("mark"))
    rows = spots.unionByName(asked, allowMissingColumns=True).withColumn("cell", mile)
    up = Window.partitionBy(*keys, "cell").orderBy("mi").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys, "cell").orderBy(F.col("mi").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    beside = rows.withColumn("_low", F.max("place").over(up)).withColumn("_high", F.min("place").over(down)).filter(F.col("mark").isNotNull())
    cells = rows.groupBy(*keys, "cell").agg(F.max("place").alias("_top"), F.min("place").alias("_bottom"))
    before = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(*keys, "cell", F.last("_top", ignorenulls=True).over(before).alias("_under"),
                           F.last("_bottom", ignorenulls=True).over(behind).alias("_over"))
    both = beside.join(carried, [*keys, "cell"])
    sides = F.array(F.coalesce("_low", "_under"), F.coalesce("_high", "_over"))
    gaps = F.transform(F.filter(sides, lambda p: p.isNotNull()), lambda p: F.struct(F.abs(p["mi"] - F.col("mi")).alias("gap"), p["seq"].alias("seq")))
    return both.select(*keys, "mark.*", F.array_min(gaps)["seq"].alias("seq"))


def climb_route_points(found: DataFrame, profile: DataFrame, points: DataFrame) -> DataFrame:
    """Route position of every climb's start and end: the profile point nearest in distance,
    the first one on a tie."""
    marks = found.select(
        *ACTIVITY, "climb_no",
        F.explode(F.array(
            F.struct(F.lit("start").alias("mark"), F.col("start_mi").alias("at_mi")),
            F.struct(F.lit("end").alias("mark"), F.col("end_mi").alias("at_mi")),
        )).alias("m"),
    ).select(*ACTIVITY, "climb_no", "m.*")
    at = nearest_places(marks, profile.select(*ACTIVITY, "distance_mi", "seq"), ACTIVITY).filter(F.col("seq").isNotNull())
    return at.join(points.select(*ACTIVITY, "seq", "lat", "lon"), [*ACTIVITY, "seq"], "left").select(
        *ACTIVITY, "seq", "climb_no", "mark", "at_mi", "lat", "lon")
