"""Per-sport totals, trends, lists and session cards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions.timekeys import DEFAULT_TZ, MISSING, as_date, iso, local_date, near_days, season_label, to_local, utc_date
from . import series

OWNER = "athlete_id"
# Fixed values.
FEET_PER_ROUTE = 45
RECENT_DAYS = 182


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


# ── totals ───────────────────────────────────────────────────────────────────

def run_totals(runs: DataFrame) -> DataFrame:
    return runs.groupBy(OWNER).agg(
        F.count(F.lit(1)).alias("total_runs"),
        N.rnd(N.miles(_total("total_distance")), 1).alias("total_miles"),
        N.rnd(N.hours(_total("total_timer_time")), 1).alias("total_hours"),
    )


def hike_totals(hikes: DataFrame) -> DataFrame:
    return hikes.groupBy(OWNER).agg(
        F.count(F.lit(1)).alias("total_hikes"),
        N.rnd(N.miles(_total("total_distance")), 1).alias("total_miles"),
        N.rnd(N.hours(_total("total_timer_time")), 1).alias("total_hours"),
        N.rint(N.feet(_total("total_ascent"))).alias("total_ascent_ft"),
    )


def hike_monthly(hikes: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    month = F.date_format(local_date("timestamp", tz), "yyyy-MM")
    return (
        hikes.groupBy(OWNER, month.alias("month"))
        .agg(
            F.count(F.lit(1)).alias("hikes"),
            N.rnd(N.miles(_total("total_distance")), 1).alias("miles"),
            N.rnd(N.hours(_total("total_timer_time")), 1).alias("hours"),
            N.rnd(N.feet(_total("total_ascent")), 0).alias("ascent_ft"),
        )
    )


def racket_totals(games: DataFrame) -> DataFrame:
    return games.groupBy(OWNER).agg(
        F.count(F.lit(1)).alias("sessions"),
        N.rnd(N.hours(_total("total_timer_time")), 1).alias("total_hours"),
        _total("total_calories").cast("bigint").alias("total_calories"),
        N.rint(F.avg("avg_heart_rate")).alias("avg_heart_rate"),
    )


def _routes_by(splits: DataFrame, *keys) -> DataFrame:
    climbs = splits.filter(F.col("split_type") == "climb_active")
    return climbs.groupBy(*keys).agg(F.count(F.lit(1)).alias("routes"))


def climb_totals(sessions: DataFrame, splits: DataFrame) -> DataFrame:
    """Totals with routes counted from climbing splits; both sides shrink to one row per
    athlete before they meet."""
    base = sessions.groupBy(OWNER).agg(
        F.count(F.lit(1)).alias("sessions"),
        N.rnd(N.hours(_total("total_timer_time")), 1).alias("total_hours"),
        _total("total_calories").cast("bigint").alias("total_calories"),
    )
    of_sessions = splits.join(sessions.select(OWNER, "source_file").distinct(), [OWNER, "source_file"], "left_semi")
    routes = F.coalesce("routes", F.lit(0).cast("bigint"))
    return base.join(_routes_by(of_sessions, OWNER), OWNER, "left").select(
        OWNER, "sessions", "total_hours", "total_calories",
        routes.alias("total_routes"),
        N.rnd(routes / F.col("sessions"), 1).alias("avg_routes"),
        (routes * FEET_PER_ROUTE).alias("total_ascent_ft"),
    )


def climb_monthly(sessions: DataFrame, splits: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    month = F.date_format(local_date("timestamp", tz), "yyyy-MM")
    monthly = sessions.groupBy(OWNER, month.alias("month")).agg(
        F.count(F.lit(1)).alias("sessions"),
        N.rnd(N.hours(_total("total_timer_time")), 1).alias("hours"),
    )
    of_sessions = splits.join(sessions.select(OWNER, "source_file").distinct(), [OWNER, "source_file"], "left_semi")
    split_month = F.date_format(local_date("start_time", tz), "yyyy-MM")
    routes = _routes_by(of_sessions, OWNER, split_month.alias("month"))
    return monthly.join(routes, [OWNER, "month"], "left").withColumn(
        "routes", F.coalesce("routes", F.lit(0).cast("bigint"))
    )


def climb_session_splits(sessions: DataFrame, splits: DataFrame) -> DataFrame:
    """Routes, climbing and resting time per climbing session."""
    active = F.col("split_type") == "climb_active"
    rest = F.col("split_type") == "climb_rest"
    per = splits.groupBy(OWNER, "source_file").agg(
        F.sum(F.when(active, 1).otherwise(0)).cast("bigint").alias("routes"),
        F.coalesce(F.sum(F.when(active, F.col("total_timer_time"))), F.lit(0.0)).alias("climb_s"),
        F.coalesce(F.sum(F.when(rest, F.col("total_timer_time"))), F.lit(0.0)).alias("rest_s"),
    )
    joined = sessions.join(per, [OWNER, "source_file"], "left")
    routes = F.coalesce("routes", F.lit(0).cast("bigint"))
    climb_s = F.coalesce("climb_s", F.lit(0.0))
    rest_s = F.coalesce("rest_s", F.lit(0.0))
    return joined.select(
        OWNER, "source_file",
        X.hours_or_seconds(F.col("total_timer_time")).alias("duration"),
        routes.alias("routes"),
        X.hours_or_seconds(climb_s).alias("climb_time"),
        X.hours_or_seconds(rest_s).alias("rest_time"),
        (routes * FEET_PER_ROUTE).alias("ascent_ft"),
        X.whole_or_dash(F.col("total_calories")).alias("calories"),
        X.whole_or_dash(F.col("avg_heart_rate")).alias("avg_hr"),
        X.whole_or_dash(F.col("max_heart_rate")).alias("max_hr"),
    )


def climb_numbering(splits: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Splits of a session in time order; climbs are numbered, rests are not.

    A climb's number is its position among the climbs only, so rests need no pass at all.
    """
    order = order or ["start_time", "message_index"]
    is_climb = F.col("split_type") == "climb_active"
    shown = [
        OWNER, "source_file", "start_time", "message_index",
        F.when(is_climb, F.lit("Climb")).otherwise(F.lit("Rest")).alias("type"),
        X.hours_or_seconds(F.col("total_timer_time")).alias("duration"),
        F.when(is_climb, F.lit(FEET_PER_ROUTE)).alias("ascent_ft"),
        X.whole_or_dash(F.col("total_calories")).alias("calories"),
    ]
    climbs = series.number_rows(
        splits.filter(is_climb), [OWNER, "source_file"], order, series.hour_bucket(order[0]), "_n"
    ).select(*shown, (F.col("_n") + 1).alias("climb_no"))
    rests = splits.filter(~is_climb | F.col("split_type").isNull()).select(
        *shown, F.lit(None).cast("bigint").alias("climb_no")
    )
    return climbs.unionByName(rests)


def ski_totals(days: DataFrame) -> DataFrame:
    """Days, seasons, laps, descent and top speed; needs ``local_date``.

    One row per day first: days then need no distinct count, and seasons one over days.
    """
    per_day = days.groupBy(OWNER, "local_date").agg(
        F.sum("total_descent").alias("_descent"), F.sum("num_laps").alias("_laps"), F.max("enhanced_max_speed").alias("_top")
    )
    return per_day.groupBy(OWNER).agg(
        F.count("local_date").alias("total_days"),
        F.count_distinct(season_label(F.col("local_date"))).alias("total_seasons"),
        N.rint(N.feet(_total("_descent"))).alias("total_descent_ft"),
        _total("_laps").cast("bigint").alias("total_laps"),
        N.rnd(N.mph(F.max("_top")), 1).alias("max_speed_mph"),
    )


def ski_daily(days: DataFrame) -> DataFrame:
    return days.groupBy(OWNER, "local_date").agg(
        N.rnd(F.avg("avg_heart_rate"), 0).alias("avg_heart_rate"),
        F.max("max_heart_rate").alias("max_heart_rate"),
        _total("total_moving_time").alias("total_moving_time"),
        _total("total_elapsed_time").alias("total_elapsed_time"),
        N.rnd(_total("total_distance"), 0).alias("total_distance"),
        N.rnd(F.avg("avg_speed"), 2).alias("avg_speed"),
        N.rnd(F.max("max_speed"), 2).alias("max_speed"),
        N.rnd(_total("total_ascent"), 0).alias("total_ascent"),
        N.rnd(_total("total_descent"), 0).alias("total_descent"),
        _total("num_laps").alias("num_laps"),
        N.rnd(F.max("enhanced_max_speed"), 2).alias("enhanced_max_speed"),
        N.rnd(F.avg("enhanced_avg_speed"), 2).alias("enhanced_avg_speed"),
    )


def ski_seasons(days: DataFrame) -> DataFrame:
    """Per season, with distinct days on piste and in the backcountry.

    Collapsing to one row per season and day first makes every distinct count a plain
    count, so the plan has no expansion of rows per distinct column.
    """
    season = season_label(F.col("local_date")).alias("season")
    per_day = days.groupBy(OWNER, season, "local_date").agg(
        F.max(F.coalesce(F.col("sport_profile_name") == "Ski", F.lit(False))).alias("_ski"),
        F.max(F.coalesce(F.col("sport_profile_name") == "Backcountry Ski", F.lit(False))).alias("_bc"),
        F.sum("avg_heart_rate").alias("_hr"), F.count("avg_heart_rate").alias("_hrn"),
        *[F.max(c).alias(c) for c in ("max_heart_rate", "enhanced_max_speed")],
        *[F.sum(c).alias(c) for c in ("total_moving_time", "total_elapsed_time", "total_distance",
                                      "total_ascent", "total_descent", "num_laps")],
    )
    return per_day.groupBy(OWNER, "season").agg(
        F.min("local_date").alias("first_day"),
        F.max("local_date").alias("last_day"),
        F.count(F.lit(1)).alias("total_days"),
        F.sum(F.col("_ski").cast("bigint")).alias("ski_days"),
        F.sum(F.col("_bc").cast("bigint")).alias("bc_days"),
        N.rnd(F.sum("_hr") / F.nullif(F.sum("_hrn"), F.lit(0)), 0).alias("avg_heart_rate"),
        F.max("max_heart_rate").alias("max_heart_rate"),
        _total("total_moving_time").alias("total_moving_time"),
        _total("total_elapsed_time").alias("total_elapsed_time"),
        N.rnd(_total("total_distance"), 0).alias("total_distance"),
        N.rnd(F.max("enhanced_max_speed"), 2).alias("max_speed"),
        N.rnd(_total("total_ascent"), 0).alias("total_ascent"),
        N.rnd(_total("total_descent"), 0).alias("total_descent"),
        _total("num_laps").alias("num_laps"),
    )


# ── one activity ─────────────────────────────────────────────────────────────

def activity_summary(rides: DataFrame, at: str | None = None, tz: str = DEFAULT_TZ) -> DataFrame:
    """Summary card of every ride, or of the ride at local time ``at``.

    Zero counts as missing for the optional measures.
    """
    local = to_local("timestamp", tz)
    if at is not None:
        rides = rides.filter(local == F.lit(at).cast("timestamp_ntz"))
    mask = F.col("left_right_balance").cast("bigint").bitwiseAND(F.lit(N.BALANCE_MASK))
    right = mask / 100

    def cut(c: str) -> Column:
        return F.col(c).cast("bigint")

    return rides.select(
        OWNER, "source_file",
        F.date_format(local, "yyyy-MM-dd hh:mm a").alias("date"),
        N.rnd(N.miles(F.col("total_distance")), 1).alias("distance_mi"),
        N.rnd(N.hours(F.col("total_timer_time")), 2).alias("duration_hr"),
        F.col("total_timer_time").alias("total_timer_time_s"),
        N.rnd(N.hours(F.col("total_elapsed_time")), 2).alias("elapsed_hr"),
        cut("avg_power").alias("avg_power"),
        cut("normalized_power").alias("normalized_power"),
        N.rnd(N.mph(N.truthy(F.col("enhanced_avg_speed"))), 1).alias("avg_speed_mph"),
        cut("avg_cadence").alias("avg_cadence"),
        F.col("avg_heart_rate").alias("avg_hr"),
        F.col("max_heart_rate").alias("max_hr"),
        X.grouped(N.rnd(N.feet(N.truthy(F.col("total_ascent"))), 0)).alias("total_ascent_ft"),
        N.rint(N.feet(N.truthy(F.col("total_descent")))).alias("total_descent_ft"),
        X.grouped(N.truthy(F.col("total_calories"))).alias("calories"),
        N.rint(N.truthy(F.col("training_stress_score"))).alias("tss"),
        "intensity_factor",
        cut("threshold_power").alias("ftp"),
        X.grouped(N.rnd(N.truthy(F.col("total_work")) / 1000, 0)).alias("work_kj"),
        N.rnd(100 - right, 1).alias("left_balance"),
        N.rnd(right, 1).alias("right_balance"),
    )


def _number(x: Column) -> Column:
    return x.cast("string")


def recent_rides(rides: DataFrame, as_of: date | str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Rides of the last 182 days by UTC date."""
    local, cutoff = to_local("timestamp", tz), F.date_sub(as_date(as_of), RECENT_DAYS)
    label = F.concat(
        iso(F.to_date(local)), F.lit(f" {MISSING} "),
        _number(N.rnd(N.miles(F.col("total_distance")), 1)), F.lit(" mi, "),
        _number(N.rnd(N.hours(F.col("total_timer_time")), 1)), F.lit(" hr"),
    )
    return (
        rides.filter(near_days("timestamp", cutoff) & (utc_date("timestamp") >= cutoff))
        .select(OWNER, "source_file", local.alias("local_timestamp"), label.alias("label"))
    )


def _recent_on_foot(sessions: DataFrame, as_of, tz: str, digits: int) -> DataFrame:
    local, cutoff = to_local("timestamp", tz), F.date_sub(as_date(as_of), RECENT_DAYS)
    distance = N.rnd(N.miles(N.truthy(F.col("total_distance"))), digits)
    label = F.concat(
        iso(F.to_date(local)), F.lit(f" {MISSING} "), F.coalesce(_number(distance), F.lit("0")), F.lit(" mi")
    )
    return (
        sessions.filter(near_days("timestamp", cutoff) & (F.to_date(local) >= cutoff))
        .select(OWNER, "source_file", local.alias("local_timestamp"), label.alias("label"))
    )


def recent_hikes(hikes: DataFrame, as_of: date | str, tz: str = DEFAULT_TZ) -> DataFrame:
    return _recent_on_foot(hikes, as_of, tz, 1)


def recent_runs(runs: DataFrame, as_of: date | str, tz: str = DEFAULT_TZ) -> DataFrame:
    return _recent_on_foot(runs, as_of, tz, 2)


def recent_ski_days(days: DataFrame, as_of: date | str, season: str | None = None) -> DataFrame:
    """Ski sessions of the last 182 days with their season; needs ``local_date``."""
    tagged = days.withColumn("season", season_label(F.col("local_date"))).filter(
        F.col("local_date") >= F.date_sub(as_date(as_of), RECENT_DAYS)
    )
    if season is not None:
        tagged = tagged.filter(F.col("season") == season)
    laps = F.coalesce(F.col("num_laps").cast("bigint"), F.lit(0).cast("bigint")).cast("string")
    feet = F.floor(N.feet(N.truthy(F.col("total_descent"))))
    descent = F.coalesce(F.concat(X.grouped(feet), F.lit(" ft")), F.lit(MISSING))
    profile = F.coalesce(F.nullif("sport_profile_name", F.lit("")), F.lit("Ski"))
    label = F.concat_ws(
        f" {MISSING} ", iso(F.col("local_date")), profile, F.concat(laps, F.lit(" laps")), descent
    )
    return tagged.select(OWNER, "source_file", "local_date", label.alias("label"), "season")


def climb_session_list(sessions: DataFrame, splits: DataFrame, tz: str = DEFAULT_TZ) -> DataFrame:
    """Every climbing session with its route count."""
    local = to_local("timestamp", tz)
    routes = _routes_by(splits, OWNER, "source_file")
    joined = sessions.join(routes, [OWNER, "source_file"], "left")
    label = F.concat(
        iso(F.to_date(local)), F.lit(f" {MISSING} "),
        F.coalesce("routes", F.lit(0)).cast("string"), F.lit(" routes, "),
        X.hours_or_seconds(F.col("total_timer_time")),
    )
    return joined.select(OWNER, "source_file", local.alias("local_timestamp"), label.alias("label"))


def _or_dash(value: Column, unit: str = "") -> Column:
    return F.coalesce(F.concat(value, F.lit(unit)) if unit else value, F.lit(MISSING))


def session_detail(sessions: DataFrame, sport: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Card rows of running, hiking, skiing or racket sessions."""
    day = iso(local_date("timestamp", tz)).alias("date")
    miles2 = _number(N.rnd(N.miles(N.truthy(F.col("total_distance"))), 2))
    pace = X.pace_per_mile(F.col("total_timer_time"), F.col("total_distance")).alias("avg_pace")
    time = lambda c: _or_dash(X.hours_minutes_seconds(F.col(c)))
    feet = lambda c: _or_dash(X.grouped(N.truthy(N.rnd(N.feet(F.col(c)), 0))), " ft")
    speed = lambda c: _or_dash(_number(N.rnd(N.mph(N.truthy(F.col(c))), 1)))
    hr = [X.whole_or_dash(F.col(f"{k}_heart_rate")).alias(f"{k}_hr") for k in ("avg", "max")]
    calories = X.whole_or_dash(F.col("total_calories")).alias("calories")
    calories_grouped = _or_dash(X.grouped(N.truthy(F.floor(F.col("total_calories")).cast("double")))).alias("calories")
    cards = {
        "running": [
            _or_dash(F.nullif("sport_profile_name", F.lit(""))).alias("profile"),
            _or_dash(miles2).alias("distance_mi"), time("total_timer_time").alias("duration"), pace,
            hr[0], calories,
        ],
        "hiking": [
            _or_dash(miles2, " mi").alias("distance"),
            X.hours_or_seconds(F.col("total_timer_time")).alias("duration"), pace,
            feet("total_ascent").alias("ascent"), feet("total_descent").alias("descent"), *hr, calories_grouped,
        ],
        "skiing": [
            F.coalesce(F.nullif("sport_profile_name", F.lit("")), F.lit("Ski")).alias("profile"),
            F.coalesce(F.col("num_laps").cast("bigint"), F.lit(0).cast("bigint")).alias("laps"),
            feet("total_descent").alias("descent"), feet("total_ascent").alias("ascent"),
            time("total_moving_time").alias("moving"), time("total_elapsed_time").alias("elapsed"),
            speed("enhanced_max_speed").alias("max_speed_mph"), speed("enhanced_avg_speed").alias("avg_speed_mph"),
            *hr, calories_grouped,
        ],
        "racket": [time("total_timer_time").alias("duration"), *hr, calories],
    }
    if sport not in cards:
        raise ValueError(f"no card for {sport!r}; expected one of {sorted(cards)}")
    return sessions.select(OWNER, "source_file", day, *cards[sport])
