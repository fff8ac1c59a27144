"""Text parsers for hand-exported files. Bad text becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "")


def parse_number(text: Column) -> Column:
    """Double from text with thousands commas and an optional trailing percent sign."""
    plain = F.regexp_replace(F.trim(text), ",", "")
    return F.regexp_replace(plain, r"\s*%$", "").try_cast("double")


def parse_whole(text: Column) -> Column:
    """Whole number from text with thousands commas; decimals are cut off."""
    value = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return value.try_cast("bigint")


def parse_date_text(text: Column) -> Column:
    """ISO date text from the accepted layouts; anything else passes through unchanged."""
    t = F.trim(text)
    # the shape is tested first: a failed timestamp parse costs an exception per value
    layouts = {
        r"^\d{4}-\d{1,2}-\d{1,2}$": "yyyy-M-d", r"^\d{1,2}/\d{1,2}/\d{4}$": "M/d/yyyy",
        r"^\d{1,2}-\d{1,2}-\d{4}$": "M-d-yyyy", r"^\d{4}/\d{1,2}/\d{1,2}$": "yyyy/M/d",
    }
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.to_date(t.try_cast("timestamp_ntz")))
    for shape, layout in layouts.items():
        day = F.when(t.rlike(shape), F.to_date(F.try_to_timestamp(t, F.lit(layout)))).otherwise(day)
    return F.when(t == "", None).otherwise(F.coalesce(F.date_format(day, "yyyy-MM-dd"), t))


def parse_duration(text: Column) -> Column:
    """Seconds from ``h:m:s``, ``m:s``, ``7h 32m``-style marks or plain digits."""
    def clock(parts: Column) -> Column:
        a, b, c = (F.get(parts, i) for i in range(3))
        return F.when(
            F.forall(parts, lambda p: p.isNotNull()),
            F.when(F.size(parts) == 3, a * 3600 + b * 60 + c).when(F.size(parts) == 2, a * 60 + b),
        )

    def seconds(mark: Column) -> Column:
        unit = F.when(mark.endswith("h"), 3600).when(mark.endswith("m"), 60).otherwise(1)
        return F.regexp_extract(mark, r"(\d+)", 1).try_cast("bigint") * unit

    def added(marks: Column) -> Column:
        total = F.aggregate(marks, F.lit(0).cast("bigint"), lambda acc, m: acc + seconds(m))
        return F.when(F.size(marks) > 0, total)

    def parsed(t: Column) -> Column:
        parts = F.transform(F.split(t, ":"), lambda p: F.trim(p).try_cast("bigint"))
        return F.coalesce(
            F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")),
            F.when(t.contains(":"), _bound(parts, clock)),
            _bound(F.regexp_extract_all(t, F.lit(r"(\d+\s*[hms])"), 1), added),
        )

    return _bound(F.lower(F.trim(text)), parsed)


def expand_sets(weights: Column, reps: Column) -> Column:
    """``"60,70"`` and ``"8,6"`` to an array of (set, weight, reps).

    A single value on either side repeats; unequal lengths or non-numbers give no sets.
    """
    def numbers(text: Column) -> Column:
        return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))

    def filled(values: Column, n: Column) -> Column:
        return F.when(F.size(values) == 1, F.array_repeat(F.get(values, 0), n)).otherwise(values)

    def same_length(typed: Column) -> Column:
        n = F.greatest(F.size(typed["w"]), F.size(typed["r"]))
        return F.struct(filled(typed["w"], n).alias("w"), filled(typed["r"], n).alias("r"))

    def numbered(pair: Column) -> Column:
        w, r = pair["w"], pair["r"]
        ok = (
            (F.size(w) == F.size(r))
            & F.forall(w, lambda x: x.isNotNull())
            & F.forall(r, lambda x: x.isNotNull())
        )
        sets = F.transform(
            F.sequence(F.lit(1), F.size(w)),
            lambda i: F.struct(
                i.alias("set"), F.get(w, i - 1).cast("double").alias("weight"), F.get(r, i - 1).alias("reps")
            ),
        )
        return F.when(ok, sets).otherwise(F.array().cast("array<struct<set:int,weight:double,reps:int>>"))

    typed = F.struct(numbers(weights).alias("w"), numbers(reps).alias("r"))
    return _bound(_bound(typed, same_length), numbered)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; a lambda evaluates what it captures anew
    for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def sets_text(sets: Column) -> Column:
    """``8x60lb | 8xBW``; weights print as whole numbers when they are whole."""

    def one(s: Column) -> Column:
        weight = F.when(
            s["weight"] == F.floor(s["weight"]), s["weight"].cast("bigint").cast("string")
        ).otherwise(s["weight"].cast("string"))
        reps = s["reps"].cast("string")
        return F.when(s["weight"] > 0, F.concat(reps, F.lit("x"), weight, F.lit("lb"))).otherwise(
            F.concat(reps, F.lit("xBW"))
        )

    return F.array_join(F.transform(sets, one), " | ")
