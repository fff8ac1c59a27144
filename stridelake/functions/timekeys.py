"""Local time and reporting-period keys."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TZ = "America/Denver"
MISSING = "—"


def to_local(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    """Stored timestamps are UTC without a zone; return the wall clock in ``tz``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz"))


def local_date(ts: Column | str, tz: str = DEFAULT_TZ) -> Column:
    return F.to_date(to_local(ts, tz))


def utc_date(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(ts.cast("timestamp_ntz"))


def near_days(ts: str, first: Column, last: Column | None = None) -> Column:
    """Bound on the bare timestamp, a day wider than the days in any zone.

    It stands beside an exact filter on a computed date, because only bounds on a stored
    column reach the reader.
    """
    bound = F.col(ts) >= F.date_sub(first, 1).cast("timestamp_ntz")
    return bound if last is None else bound & (F.col(ts) < F.date_add(last, 2).cast("timestamp_ntz"))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds of two zoneless timestamps, whatever the session's zone is."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap).cast("double")
    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def as_date(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def monday(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def iso(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def period_keys(day: Column, grain: str) -> dict[str, Column]:
    """Grouping columns of a period; ``year`` of a week is the year of its Monday."""
    if grain == "year":
        return {"year": F.year(day)}
    if grain == "month":
        return {"year": F.year(day), "month": F.month(day)}
    if grain == "week":
        start = monday(day)
        return {
            "year": F.year(start),
            "week_starting": iso(start),
            "week_ending": iso(F.date_add(start, 6)),
        }
    raise ValueError(f"grain must be year, month or week, not {grain!r}")


def period_label(day: Column, grain: str) -> Column:
    """One sortable text per period: ``2024``, ``2024-03`` or the Monday's date."""
    if grain == "year":
        return F.date_format(day, "yyyy")
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    if grain == "week":
        return iso(monday(day))
    raise ValueError(f"grain must be year, month or week, not {grain!r}")


def season_label(day: Column) -> Column:
    """Winter season, October to September, as ``2024-25``."""
    start = F.when(F.month(day) >= 10, F.year(day)).otherwise(F.year(day) - 1)
    return F.concat(
        start.cast("string"), F.lit("-"), F.substring((start + 1).cast("string"), 3, 2)
    )
