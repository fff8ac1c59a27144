"""Display text built from numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timekeys import MISSING


def _whole(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def clock(seconds: Column) -> Column:
    """``HH:MM:SS``; more than 99 hours simply needs more digits."""
    s = seconds
    return F.format_string(
        "%02d:%02d:%02d", _whole(s / 3600), _whole((s % 3600) / 60), _whole(s % 60)
    )


def hours_minutes(seconds: Column) -> Column:
    """``2h 5m`` or ``5m``."""
    h, m = _whole(seconds / 3600), _whole((seconds % 3600) / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm", m))


def hours_minutes_seconds(seconds: Column) -> Column:
    """``1h 2m 3s`` or ``2m 3s``; null stays null."""
    s = seconds.cast("bigint")
    h, m, sec = _whole(s / 3600), _whole((s % 3600) / 60), s % 60
    return F.when(seconds.isNull(), None).when(
        h > 0, F.format_string("%dh %dm %ds", h, m, sec)
    ).otherwise(F.format_string("%dm %ds", m, sec))


def hours_or_seconds(seconds: Column) -> Column:
    """``1h 2m`` or ``2m 3s``; a dash when missing."""
    s = seconds.cast("bigint")
    h, m, sec = _whole(s / 3600), _whole((s % 3600) / 60), s % 60
    return F.when(seconds.isNull(), F.lit(MISSING)).when(
        h > 0, F.format_string("%dh %dm", h, m)
    ).otherwise(F.format_string("%dm %ds", m, sec))


def duration_label(seconds: Column) -> Column:
    """Axis label of a whole number of seconds: ``45s``, ``5min``, ``1h30``, ``2h``."""
    h, m = _whole(seconds / 3600), _whole((seconds % 3600) / 60)
    return (
        F.when(seconds < 60, F.format_string("%ds", seconds))
        .when(seconds < 3600, F.format_string("%dmin", _whole(seconds / 60)))
        .when(m > 0, F.format_string("%dh%02d", h, m))
        .otherwise(F.format_string("%dh", h))
    )


def short_duration_label(seconds: Column) -> Column:
    """Coarser axis label: ``45s``, ``5m``, ``1h``."""
    return (
        F.when(seconds < 60, F.format_string("%ds", seconds))
        .when(seconds < 3600, F.format_string("%dm", _whole(seconds / 60)))
        .otherwise(F.format_string("%dh", _whole(seconds / 3600)))
    )


def pace_per_mile(seconds: Column, metres: Column) -> Column:
    """``m:ss /mi``, seconds cut not rounded; a dash without time or distance."""
    per_mile = seconds / (metres / 1609.344)
    ok = (metres > 0) & (seconds > 0)
    text = F.format_string("%d:%02d /mi", _whole(per_mile / 60), _whole(per_mile % 60))
    return F.when(ok, text).otherwise(F.lit(MISSING))


def grouped(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(x.cast("double"), 0)


def whole_or_dash(x: Column) -> Column:
    """Truncated whole number as text; missing or zero becomes a dash."""
    return F.when(x != 0, x.cast("bigint").cast("string")).otherwise(F.lit(MISSING))


def title_words(name: Column) -> Column:
    return F.initcap(F.translate(name, "_", " "))


def exercise_key(name: Column) -> Column:
    """Stored form of an exercise name: trimmed, lower case, underscores for blanks."""
    return F.translate(F.lower(F.trim(name)), " ", "_")
