"""Monthly peak power against training stress and sleep: regression and bootstrap.

A group is one athlete and variant with one row per calendar month.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import Z_95, f_tail_p, normal_two_sided_p, rnd
from ..functions.timekeys import DEFAULT_TZ, local_date, month_start
from ..session import shuffle_width
from .series import ACTIVITY

OWNER = "athlete_id"
MODEL = [OWNER, "variant", "dep"]
# Fixed values.
PEAKS = {120: "2min", 300: "5min", 1200: "20min"}
MIN_MONTHS = 5
LAGS = 3
SEED = 42
BOOTSTRAP = 5000
# replicates generated by one task from one group's months
SLICE = 500


def ride_peaks(sessions: DataFrame, curves: DataFrame, peaks: dict[int, str] = PEAKS,
               tz: str = DEFAULT_TZ) -> DataFrame:
    """Sessions with a stored curve, their local day and month and their peaks, one column
    per label."""
    wide = curves.filter(F.col("duration_s").isin(list(peaks))).groupBy(*ACTIVITY).agg(
        *[F.max(F.when(F.col("duration_s") == d, F.col("watts"))).alias(label) for d, label in peaks.items()]
    )
    day = local_date("timestamp", tz)
    return sessions.select(
        *ACTIVITY, day.alias("day"), month_start(day).alias("month"), "training_stress_score"
    ).join(wide, ACTIVITY)


def monthly_peaks(rides: DataFrame, labels: list[str]) -> DataFrame:
    return rides.groupBy(OWNER, "month").agg(
        *[F.max(c).alias(c) for c in labels],
        (F.coalesce(F.sum("training_stress_score"), F.lit(0.0)) / 100).alias("tss_per_100"),
    )


def monthly_sleep(rides: DataFrame, nights: DataFrame) -> DataFrame:
    """Mean score of the nights before the month's rides, one count per ride."""
    scores = nights.filter(F.col("calendar_date").isNotNull()).select(
        OWNER, F.col("calendar_date").cast("date").alias("_night"), "score_overall"
    )
    with_night = rides.select(OWNER, "month", F.date_sub("day", 1).alias("_night"))
    return with_night.join(scores, [OWNER, "_night"], "left").groupBy(OWNER, "month").agg(
        F.avg("score_overall").alias("sleep_score")
    )


def design(monthly: DataFrame, sleep: DataFrame | None, labels: list[str]) -> DataFrame:
    """Months of both model variants with centred covariates, complete rows only.

    Groups under five months, or without a covariate that varies, drop out. A covariate
    that does not vary is null throughout its group.
    """
    plain = monthly.dropna("any").select(
        OWNER, F.lit("no_sleep").alias("variant"), "month", *labels, "tss_per_100",
        F.lit(None).cast("double").alias("sleep_score"),
    )
    both = plain
    if sleep is not None:
        joined = monthly.join(sleep, [OWNER, "month"]).dropna("any")
        both = plain.unionByName(joined.select(
            OWNER, F.lit("sleep").alias("variant"), "month", *labels, "tss_per_100", "sleep_score"
        ))
    g = Window.partitionBy(OWNER, "variant")

    def centred(c: str) -> Column:
        varies = F.max(c).over(g) > F.min(c).over(g)
        return F.when(varies, F.col(c) - F.avg(c).over(g))

    return both.select(
        OWNER, "variant", "month", *labels, F.count(F.lit(1)).over(g).alias("n"),
        centred("tss_per_100").alias("x1"), centred("sleep_score").alias("x2"),
    ).filter((F.col("n") >= MIN_MONTHS) & (F.col("x1").isNotNull() | F.col("x2").isNotNull()))


def _slopes(s11, s12, s22, s1y, s2y, has1, has2) -> tuple[Column, Column]:
    """Least squares from centred sums; null for an absent term or a singular system."""
    det = s11 * s22 - s12 * s12
    fine = det > 1e-12 * s11 * s22
    b1 = F.when(has1 & has2, F.when(fine, (s1y * s22 - s2y * s12) / det)).when(has1 & (s11 > 0), s1y / s11)
    b2 = F.when(has1 & has2, F.when(fine, (s2y * s11 - s1y * s12) / det)).when(has2 & (s22 > 0), s2y / s22)
    return b1, b2


def smallest_solution(sums: DataFrame) -> DataFrame:
    """Add least-squares ``b0 b1 b2``; of several solutions the one of smallest norm.

    Input columns are centred sums s11 s12 s22 s1y s2y and means a1 a2 ybar, an absent
    covariate being all zero. Points on a line (or one point) in covariate space fix the
    fit only along it; the rest follows from minimising the norm under the one or two
    equations that remain. Each step is a projection of its own, so shared parts are
    computed once.
    """
    s11, s12, s22, s1y, s2y, a1, a2, ybar = (F.col(c) for c in "s11 s12 s22 s1y s2y a1 a2 ybar".split())
    keep = sums.columns
    ranked = sums.withColumns({
        "_det": s11 * s22 - s12 * s12, "_line": s11 + s22 > 0,
        "_u1": F.when(s11 >= s22, s11).otherwise(s12), "_u2": F.when(s11 >= s22, s12).otherwise(s22),
    })
    size = F.sqrt(F.col("_u1") * F.col("_u1") + F.col("_u2") * F.col("_u2"))
    unit = ranked.withColumns({
        "_plane": (s11 > 0) & (s22 > 0) & (F.col("_det") > 1e-12 * s11 * s22),
        "_d1": F.when(F.col("_line"), F.col("_u1") / size).otherwise(0.0),
        "_d2": F.when(F.col("_line"), F.col("_u2") / size).otherwise(0.0),
    })
    d1, d2, line, plane = F.col("_d1"), F.col("_d2"), F.col("_line"), F.col("_plane")
    projected = unit.withColumns({
        "_along": F.when(line, (d1 * s1y + d2 * s2y) / (s11 + s22)).otherwise(0.0),
        "_dot": a1 * d1 + a2 * d2, "_norm": 1 + a1 * a1 + a2 * a2,
    })
    along, dot, norm = F.col("_along"), F.col("_dot"), F.col("_norm")
    weighed = projected.withColumns({
        "_k1": (ybar - dot * along) / (norm - dot * dot),
        "_k2": F.when(line, (norm * along - dot * ybar) / (norm - dot * dot)).otherwise(0.0),
    })
    k1, k2 = F.col("_k1"), F.col("_k2")
    slopes = weighed.withColumns({
        "b1": F.when(plane, (s1y * s22 - s2y * s12) / F.col("_det")).otherwise(k1 * a1 + k2 * d1),
        "b2": F.when(plane, (s2y * s11 - s1y * s12) / F.col("_det")).otherwise(k1 * a2 + k2 * d2),
    })
    b0 = F.when(plane, ybar - F.col("b1") * a1 - F.col("b2") * a2).otherwise(k1)
    return slopes.select(*keep, b0.alias("b0"), "b1", "b2")


def fit_models(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row per athlete, variant and peak: coefficients, fit quality and lag-robust
    (Bartlett, three lags) variances.

    Everything is sums over one group's months, so one shuffle by group serves it all.
    """
    stacked = rows.select(
        OWNER, "variant", "month", "n", "x1", "x2",
        F.explode(F.array(*[F.struct(F.lit(c).alias("dep"), F.col(c).alias("y")) for c in labels])).alias("d"),
    ).select(OWNER, "variant", "d.dep", "month", "n", "x1", "x2", F.col("d.y").alias("y"))
    g = Window.partitionBy(*MODEL)
    t = g.orderBy("month")
    x1, x2 = F.coalesce("x1", F.lit(0.0)), F.coalesce("x2", F.lit(0.0))
    has1, has2 = F.col("x1").isNotNull(), F.col("x2").isNotNull()
    mean = F.avg("y").over(g)
    sums = stacked.select(
        *MODEL, "month", "n", x1.alias("x1"), x2.alias("x2"), has1.alias("h1"), has2.alias("h2"), "y", mean.alias("b0"),
        *[F.sum(e).over(g).alias(a) for a, e in {
            "s11": x1 * x1, "s12": x1 * x2, "s22": x2 * x2, "s1y": x1 * F.col("y"), "s2y": x2 * F.col("y")}.items()],
    )
    b1, b2 = _slopes(*[F.col(c) for c in ("s11", "s12", "s22", "s1y", "s2y", "h1", "h2")])
    resid = sums.withColumn("b1", b1).withColumn("b2", b2).withColumn(
        "e", F.col("y") - F.col("b0") - F.coalesce("b1", F.lit(0.0)) * F.col("x1") - F.coalesce("b2", F.lit(0.0)) * F.col("x2")
    )
    scored = resid.withColumn("u0", F.col("e")).withColumn("u1", F.col("e") * F.col("x1")).withColumn("u2", F.col("e") * F.col("x2"))
    scored = scored.select("*", *[
        F.coalesce(F.lag(f"u{k}", lag).over(t), F.lit(0.0)).alias(f"u{k}_{lag}") for k in range(3) for lag in range(1, LAGS + 1)
    ])

    def spectral(a: int, b: int) -> Column:
        total = F.sum(F.col(f"u{a}") * F.col(f"u{b}"))
        for lag in range(1, LAGS + 1):
            pair = F.col(f"u{a}") * F.col(f"u{b}_{lag}") + F.col(f"u{a}_{lag}") * F.col(f"u{b}")
            total = total + F.sum(pair) * (1 - lag / (LAGS + 1))
        return total

    once = ["n", "h1", "h2", "b0", "b1", "b2", "s11", "s12", "s22"]
    fitted = scored.groupBy(*MODEL).agg(
        *[F.first(c).alias(c) for c in once],
        F.sum(F.col("e") * F.col("e")).alias("ssr"), F.sum(F.pow(F.col("y") - F.col("b0"), 2)).alias("sst"),
        *[spectral(a, b).alias(f"q{a}{b}") for a, b in ((0, 0), (1, 1), (1, 2), (2, 2))],
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    two = F.col("h1") & F.col("h2")
    g11 = F.when(two, F.col("s22") / det).when(F.col("h1"), 1 / F.col("s11")).otherwise(0.0)
    g22 = F.when(two, F.col("s11") / det).when(F.col("h2"), 1 / F.col("s22")).otherwise(0.0)
    g12 = F.when(two, -F.col("s12") / det).otherwise(0.0)
    inv = fitted.select("*", g11.alias("g11"), g22.alias("g22"), g12.alias("g12"))
    q11, q12, q22 = F.col("q11"), F.col("q12"), F.col("q22")
    a, b, c = F.col("g11"), F.col("g12"), F.col("g22")
    robust = inv.select(
        *MODEL, "n", "h1", "h2", "b0", "b1", "b2", "ssr", "sst",
        (F.col("q00") / (F.col("n") * F.col("n"))).alias("v0"),
        (a * a * q11 + 2 * a * b * q12 + b * b * q22).alias("v1"),
        (b * b * q11 + 2 * b * c * q12 + c * c * q22).alias("v2"),
        (a * b * q11 + (a * c + b * b) * q12 + b * c * q22).alias("v12"),
    )
    terms = F.col("h1").cast("int") + F.col("h2").cast("int")
    v1, v2, v12 = F.col("v1"), F.col("v2"), F.col("v12")
    wald = F.when(
        F.col("h1") & F.col("h2"),
        F.try_divide(
            F.col("b1") * F.col("b1") * v2 - 2 * F.col("b1") * F.col("b2") * v12 + F.col("b2") * F.col("b2") * v1,
            (v1 * v2 - v12 * v12) * 2,
        ),
    ).when(F.col("h1"), F.try_divide(F.col("b1") * F.col("b1"), v1)).otherwise(F.try_divide(F.col("b2") * F.col("b2"), v2))
    r2 = 1 - F.try_divide(F.col("ssr"), F.col("sst"))
    left = F.col("n") - terms - 1
    return robust.select(
        "*", terms.alias("terms"), r2.alias("r2"),
        (1 - (1 - r2) * (F.col("n") - 1) / left).alias("r2_adj"),
        wald.alias("f"), f_tail_p(wald, terms, left.cast("double")).alias("f_pvalue"),
    )


def model_summary(fits: DataFrame) -> DataFrame:
    return fits.select(
        *MODEL, "n", rnd(F.col("r2"), 3).alias("r2"), rnd(F.col("r2_adj"), 3).alias("r2_adj"),
        rnd(F.col("f_pvalue"), 4).alias("f_pvalue"),
    )


TERMS = [("const", 0), ("tss_per_100", 1), ("sleep_score", 2)]


def coefficients(fits: DataFrame) -> DataFrame:
    """Coefficient, robust standard error, normal p-value and 95 % interval per term."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("term"), F.col(f"b{k}").alias("_c"), F.sqrt(f"v{k}").alias("_e"))
        for name, k in TERMS
    ])
    # the exact values keep names of their own: a lambda may resolve to a like-named output
    flat = fits.select(*MODEL, F.explode(rows).alias("t")).select(*MODEL, "t.*").filter(F.col("_c").isNotNull())
    exact, error = F.col("_c"), F.col("_e")
    return flat.select(
        *MODEL, "term", rnd(exact, 4).alias("coef"), rnd(error, 4).alias("se"),
        rnd(normal_two_sided_p(F.try_divide("_c", "_e")), 4).alias("pvalue"),
        rnd(exact - Z_95 * error, 4).alias("ci_low"), rnd(exact + Z_95 * error, 4).alias("ci_high"),
    )


def correlations(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Correlation of every pair of peaks and varying covariates, long form."""
    columns = {**{c: c for c in labels}, "tss_per_100": "x1", "sleep_score": "x2"}
    names = list(columns)
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]

    def corr(p: str, q: str) -> Column:
        a, b = F.col(columns[p]), F.col(columns[q])
        varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
        return F.when(varies, F.lit(1.0) if p == q else F.corr(a, b))

    wide = rows.groupBy(OWNER, "variant").agg(
        *[corr(p, q).alias(f"r{i}") for i, (p, q) in enumerate(pairs)],
        *[F.count(columns[c]).alias(f"k_{c}") for c in ("tss_per_100", "sleep_score")],
    )
    entries = []
    for i, (p, q) in enumerate(pairs):
        present = reduce(
            lambda x, y: x & y, [F.col(f"k_{c}") > 0 for c in (p, q) if c in ("tss_per_100", "sleep_score")], F.lit(True)
        )
        for left, right in {(p, q), (q, p)}:
            entries.append(F.when(present, F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), rnd(F.col(f"r{i}"), 3).alias("r"))))
    return wide.select(OWNER, "variant", F.explode(F.array(*entries)).alias("e")).filter("e is not null").select(
        OWNER, "variant", "e.*"
    )


def draw(b: np.ndarray, j: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Month drawn by replicate ``b`` at place ``j``: an integer hash of the three numbers,
    so the result does not depend on partitioning or retries."""
    top = 1 << 32
    x = (b * 7919 + j * 104729 + seed * 15485863) % top
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) % top
    return (x ^ (x >> 16)) % n


def _drawn_sums(group: list[str], names: list[str], replicates: int, seed: int):
    """Sums of every replicate of a slice: one gather and one sum of a (replicate, place, part) block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                m = np.array([list(v) for v in row["m"]], float)
                b = np.arange(row["slice"] * SLICE, min((row["slice"] + 1) * SLICE, replicates), dtype=np.int64)
                picked = draw(b[:, None], np.arange(len(m), dtype=np.int64)[None, :], len(m), seed)
                out = pd.DataFrame(np.nansum(m[picked], axis=1), columns=names)
                out.insert(0, "n", np.int64(len(m)))
                for k, g in enumerate(group):
                    out.insert(k, g, row[g])
                yield out

    return run


def bootstrap(rows: DataFrame, labels: list[str], fits: DataFrame, replicates: int = BOOTSTRAP,
              seed: int = SEED) -> DataFrame:
    """Case-resampling distribution of every coefficient.

    The months of a group ride along as one short array. Replicates are generated in
    slices over the cluster and summed where they are generated, so only one row of sums per
    replicate is shuffled. Where the drawn months
    leave the slopes undetermined the solution of smallest norm counts.
    """
    p, q = F.coalesce("x1", F.lit(0.0)), F.coalesce("x2", F.lit(0.0))
    # a month carries its products, so a draw adds plain doubles
    parts = {"p": p, "q": q, "pp": p * p, "pq": p * q, "qq": q * q}
    for c in labels:
        parts |= {f"y_{c}": F.col(c), f"p_{c}": p * F.col(c), f"q_{c}": q * F.col(c)}
    values = rows.select(
        OWNER, "variant", "month", F.col("x1").isNotNull().alias("h1"), F.col("x2").isNotNull().alias("h2"),
        F.array(*[v for v in parts.values()]).alias("v"),
    )
    group = [OWNER, "variant", "h1", "h2"]
    months = values.groupBy(*group).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("month", "v"))), lambda m: m["v"]).alias("m")
    )
    slices = -(-replicates // SLICE)
    cut = months.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(
        shuffle_width(rows), OWNER, "variant", "slice"
    )
    # the draws of a slice are summed where they are made: nothing is shuffled in between
    schema = f"{OWNER} string, variant string, h1 boolean, h2 boolean, n bigint, " + ", ".join(f"`{k}` double" for k in parts)
    gram = cut.select(*group, "m", "slice").mapInPandas(_drawn_sums(group, list(parts), replicates, seed), schema)
    n, sp, sq = F.col("n"), F.col("p"), F.col("q")
    shared = gram.select(
        *group, "n", (sp / n).alias("a1"), (sq / n).alias("a2"), "p", "q",
        # squares below summation noise are zero
        F.when(F.col("pp") - sp * sp / n > 1e-9 * F.col("pp"), F.col("pp") - sp * sp / n).otherwise(0.0).alias("s11"),
        F.when(F.col("qq") - sq * sq / n > 1e-9 * F.col("qq"), F.col("qq") - sq * sq / n).otherwise(0.0).alias("s22"),
        (F.col("pq") - sp * sq / n).alias("s12"),
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("dep"), F.col(f"y_{c}").alias("y"), F.col(f"p_{c}").alias("py"), F.col(f"q_{c}").alias("qy")) for c in labels
        ])).alias("d"),
    )
    y = F.col("d.y")
    solved = smallest_solution(shared.select(
        *group, F.col("d.dep").alias("dep"), "a1", "a2", "s11", "s12", "s22", (y / n).alias("ybar"),
        (F.col("d.py") - sp * y / n).alias("s1y"), (F.col("d.qy") - sq * y / n).alias("s2y"),
    ))
    # zero up to summation noise is zero, whatever the order of addition
    kept = solved.select(
        *MODEL, F.round("b0", 9).alias("b0"), F.when(F.col("h1"), F.round("b1", 9)).alias("b1"), F.when(F.col("h2"), F.round("b2", 9)).alias("b2")
    )
    stats = kept.groupBy(*MODEL).agg(*[
        F.struct(
            F.lit(name).alias("term"), F.count(f"b{k}").alias("n_bootstrap"),
            F.percentile(f"b{k}", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("pc"), F.avg(f"b{k}").alias("mean"),
            F.avg((F.col(f"b{k}") <= 0).cast("double")).alias("le"), F.avg((F.col(f"b{k}") >= 0).cast("double")).alias("ge"),
        ).alias(f"s{k}") for name, k in TERMS
    ])
    rows_out = stats.select(*MODEL, F.explode(F.array(*[F.col(f"s{k}") for _, k in TERMS])).alias("s")).select(
        *MODEL, "s.*"
    ).filter(F.col("n_bootstrap") > 0)
    point = fits.select(*MODEL, F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"b{k}").alias("point")) for t, k in TERMS])).alias("t")).select(*MODEL, "t.*")
    signed = F.when(F.col("point") >= 0, F.col("le")).otherwise(F.col("ge"))
    return rows_out.join(point, [*MODEL, "term"]).select(
        *MODEL, "term", "n_bootstrap",
        rnd(F.get("pc", F.lit(1)), 4).alias("coef_median"), rnd(F.col("mean"), 4).alias("coef_mean"),
        rnd(F.least(2 * signed, F.lit(1.0)), 4).alias("pvalue_boot"),
        rnd(F.get("pc", F.lit(0)), 4).alias("boot_low"), rnd(F.get("pc", F.lit(2)), 4).alias("boot_high"),
    )


def report(terms: DataFrame, boot: DataFrame) -> DataFrame:
    """Coefficients with bootstrap statistics where there are any; their interval replaces
    the analytic one, and significance means the interval excludes zero."""
    joined = terms.join(boot, [*MODEL, "term"], "left")
    low, high = F.coalesce("boot_low", "ci_low"), F.coalesce("boot_high", "ci_high")
    return joined.select(
        *MODEL, "term", "coef", "coef_median", "coef_mean", "pvalue", "pvalue_boot",
        low.alias("ci_low"), high.alias("ci_high"),
        F.when(F.col("boot_low").isNotNull(), "bootstrap").otherwise("robust").alias("ci_method"),
        (~((low <= 0) & (high >= 0))).alias("significant"), "n_bootstrap",
    )
