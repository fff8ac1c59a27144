"""Rounding, unit conversion and tail probabilities as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors and the two-sided 95 % normal quantile.
METRES_PER_MILE = 1609.344
FEET_PER_METRE = 3.28084
MPH_PER_MPS = 2.23694
SECONDS_PER_HOUR = 3600.0
DEGREES_PER_SEMICIRCLE = 180.0 / 2**31
BALANCE_MASK = 0x3FFF
Z_95 = 1.959963984540054


def rnd(x: Column, digits: int = 0) -> Column:
    """Half-even rounding of the scaled binary value, kept as double.

    ``rint`` stays in primitive doubles, where ``bround`` would build a decimal per row.
    """
    if digits == 0:
        return F.rint(x.cast("double"))
    scale = F.lit(10.0**digits)
    return F.rint(x.cast("double") * scale) / scale


#: Factor that splits a double into two halves of 26 bits, whose products are exact.
SPLITTER = 2.0**27 + 1


def exact(x: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, as a general-purpose language's ``round`` does it: 1.115 to two
    digits is 1.11, since the double lies below the tie.

    The scaled value is rounded once more by its residual: the error of the product, found without error from the halves
    of both factors, tells on which side of an apparent tie the exact value lies. Values under 2^52 in scaled size.
    """
    x, scale = x.cast("double"), 10.0**digits
    cut = scale * SPLITTER
    s_high = cut - (cut - scale)
    s_low = scale - s_high
    product, wide = x * F.lit(scale), x * F.lit(SPLITTER)
    high = wide - (wide - x)
    low = x - high
    error = ((high * s_high - product) + high * s_low + low * s_high) + low * s_low
    whole = F.rint(product)
    off = product - whole
    nearest = F.when((off == 0.5) & (error > 0), whole + 1).when((off == -0.5) & (error < 0), whole - 1).otherwise(whole)
    return nearest / F.lit(scale)


def exact_sql(x: str, digits: int) -> str:
    """The same in SQL: printing a double to some digits goes by its exact value."""
    return f"cast(format('{{:.{digits}f}}', {x}) as double)"


def rint(x: Column) -> Column:
    return F.rint(x.cast("double")).cast("bigint")


def mean(x: Column | str, digits: int) -> Column:
    """Average to ``digits``; summation noise is cut first, so a tie does not depend on the
    order in which partitions were added."""
    return rnd(F.round(F.avg(x), 9), digits)


def miles(metres: Column) -> Column:
    return metres / F.lit(METRES_PER_MILE)


def feet(metres: Column) -> Column:
    return metres * F.lit(FEET_PER_METRE)


def mph(speed: Column) -> Column:
    return speed * F.lit(MPH_PER_MPS)


def hours(seconds: Column) -> Column:
    return seconds / F.lit(SECONDS_PER_HOUR)


def degrees(semicircles: Column) -> Column:
    return semicircles * F.lit(DEGREES_PER_SEMICIRCLE)


def truthy(x: Column) -> Column:
    """Zero counts as missing, as it does in the activity cards."""
    return F.nullif(x, F.lit(0.0))


def normal_two_sided_p(z: Column) -> Column:
    """P(|N(0,1)| > |z|) from the all-positive erf series; beyond 8 it is below 1e-14."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    start = F.struct(x.alias("term"), x.alias("total"))

    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2 * x * x / (2 * n + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(200)), start, step, lambda a: a["total"])
    erf = F.lit(2 / math.sqrt(math.pi)) * F.exp(-x * x) * series
    return F.when(z.isNull(), None).when(F.abs(z) > 8, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - erf)
    )


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student tail for whole degrees of freedom (finite trigonometric sum)."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.pow(F.cos(theta), 2)
    odd = (df % 2) == 1
    # terms of the finite sum: odd df start from cos, even df from 1
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0)).cast("double")
    count = F.when(odd, (df - 1) / 2).otherwise(df / 2).cast("int")
    steps = F.when(count > 1, F.sequence(F.lit(1), count - 1)).otherwise(
        F.array().cast("array<int>")
    )

    def step(acc: Column, k: Column) -> Column:
        ratio = F.when(odd, (2 * k) / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = acc["term"] * ratio * c2
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("total")), step, lambda a: a["total"]
    )
    inside = F.when(count < 1, F.lit(0.0)).otherwise(F.sin(theta) * total)
    area = F.when(odd, F.lit(2 / math.pi) * (theta + inside)).otherwise(inside)
    return F.greatest(F.lit(0.0), 1 - area)


def f_tail_p(f: Column, numerator_df: Column, denominator_df: Column) -> Column:
    """P(F(q, m) > f) for q of 1 or 2, the only model sizes in use."""
    one = t_two_sided_p(F.sqrt(f), denominator_df)
    two = F.pow(1 + 2 * f / denominator_df, -denominator_df / 2)
    return F.when(numerator_df == 1, one).otherwise(two)
