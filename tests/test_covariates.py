import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.functions import numeric as N
from stridelake.operators import covariates as K

LABELS = ["2min", "5min"]


def _monthly(spark, months=14, athletes=("a",), constant=False):
    rnd = random.Random(4)
    rows, sleep = [], []
    for a in athletes:
        for i in range(months):
            m = dt.date(2022 + i // 12, i % 12 + 1, 1)
            tss = 3.0 if constant else rnd.uniform(0, 8)
            score = rnd.uniform(50, 95)
            rows.append((a, m, 300 + 5 * tss + rnd.gauss(0, 4), 250 + 3 * tss - 0.2 * score + rnd.gauss(0, 4), tss))
            if i != 3:
                sleep.append((a, m, score))
    return (spark.createDataFrame(rows, "athlete_id string, month date, `2min` double, `5min` double, tss_per_100 double"),
            spark.createDataFrame(sleep, "athlete_id string, month date, sleep_score double"), rows, sleep)


def _numpy_fit(rows, sleep, use_sleep):
    score = {m: s for _, m, s in sleep}
    data = [(r, score.get(r[1])) for r in rows if not use_sleep or r[1] in score]
    y = np.array([r[3] for r, _ in data])
    cols = [np.array([r[4] for r, _ in data])] + ([np.array([s for _, s in data])] if use_sleep else [])
    x = np.column_stack([np.ones(len(y))] + [c - c.mean() for c in cols])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    e = y - x @ beta
    u = x * e[:, None]
    meat = u.T @ u
    for lag in (1, 2, 3):
        g = u[lag:].T @ u[:-lag]
        meat += (1 - lag / 4) * (g + g.T)
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ meat @ inv
    return beta, np.sqrt(np.diag(cov)), cov, 1 - e @ e / ((y - y.mean()) ** 2).sum(), len(y)


@pytest.mark.parametrize("use_sleep", [False, True])
def test_coefficients_and_robust_errors_match_matrix_algebra(spark, use_sleep):
    monthly, nights, rows, sleep = _monthly(spark)
    fits = K.fit_models(K.design(monthly, nights, LABELS), LABELS)
    variant = "sleep" if use_sleep else "no_sleep"
    beta, se, cov, r2, n = _numpy_fit(rows, sleep, use_sleep)
    got = fits.filter((F.col("variant") == variant) & (F.col("dep") == "5min")).first()
    assert [got.b0, got.b1] + ([got.b2] if use_sleep else []) == pytest.approx(list(beta))
    assert [math.sqrt(v) for v in (got.v0, got.v1, got.v2)[:len(beta)]] == pytest.approx(list(se))
    assert got.r2 == pytest.approx(r2) and got.n == n
    slope, v = beta[1:], cov[1:, 1:]
    assert got.f == pytest.approx(slope @ np.linalg.inv(v) @ slope / len(slope))
    terms = {r.term: r for r in K.coefficients(fits).filter((F.col("variant") == variant) & (F.col("dep") == "5min")).collect()}
    z = beta[1] / se[1]
    assert terms["tss_per_100"].pvalue == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=6e-5)


def test_tail_probabilities(spark):
    values = spark.createDataFrame([(z,) for z in (0.0, 0.3, -1.96, 3.5, 7.9, 12.0)], "z double")
    for r in values.select("z", N.normal_two_sided_p(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-12)
    # textbook critical values: 5 % two-sided t, 5 % upper F(2, m)
    t = spark.createDataFrame([(1.0, 12.706), (2.0, 4.303), (5.0, 2.571), (10.0, 2.228), (29.0, 2.045)], "m double, t double")
    assert [r[0] for r in t.select(N.t_two_sided_p(F.col("t"), F.col("m"))).collect()] == pytest.approx([0.05] * 5, abs=2e-4)
    f = spark.createDataFrame([(5.0, 5.786), (10.0, 4.103), (30.0, 3.316)], "m double, f double")
    assert [r[0] for r in f.select(N.f_tail_p(F.col("f"), F.lit(2), F.col("m"))).collect()] == pytest.approx([0.05] * 3, abs=2e-4)


def test_small_or_constant_groups_have_no_model(spark):
    monthly, nights, *_ = _monthly(spark, months=4)
    assert K.design(monthly, nights, LABELS).count() == 0
    monthly, nights, *_ = _monthly(spark, constant=True)
    rows = K.design(monthly, nights, LABELS)
    assert {r.variant for r in rows.select("variant").distinct().collect()} == {"sleep"}
    got = K.fit_models(rows, LABELS).first()
    assert got.b1 is None and got.b2 is not None and got.terms == 1
    corr = K.correlations(rows, LABELS)
    assert corr.filter("a = 'tss_per_100'").count() == 0 and corr.filter("a = b").select("r").distinct().collect()[0].r == 1.0


def test_bootstrap_is_repeatable_and_brackets_the_estimate(spark):
    monthly, nights, *_ = _monthly(spark, months=30, athletes=("a", "b"))
    rows = K.design(monthly, nights, LABELS).checkpoint() if spark.sparkContext.getCheckpointDir() else K.design(monthly, nights, LABELS)
    fits = K.fit_models(rows, LABELS)
    key = lambda r: (r.athlete_id, r.variant, r.dep, r.term)
    first = sorted(K.bootstrap(rows, LABELS, fits, 700).collect(), key=key)
    again = sorted(K.bootstrap(rows.repartition(7), LABELS, fits, 700).collect(), key=key)
    for x, y in zip(first, again):
        assert key(x) == key(y) and [x.coef_median, x.boot_low, x.boot_high, x.pvalue_boot] == pytest.approx([y.coef_median, y.boot_low, y.boot_high, y.pvalue_boot], abs=2e-4)
    assert len(first) == len(again) == 2 * 2 * (2 + 3) and {r.n_bootstrap for r in first} == {700}
    full = K.report(K.coefficients(fits), K.bootstrap(rows, LABELS, fits, 700)).collect()
    assert all(r.ci_low <= r.coef <= r.ci_high for r in full) and {r.ci_method for r in full} == {"bootstrap"}
    assert all(r.significant for r in full if r.term == "const")


def test_sleep_counts_the_night_before_each_ride(spark):
    rides = spark.createDataFrame([("a", "r1", dt.date(2024, 5, 2), dt.date(2024, 5, 1)), ("a", "r2", dt.date(2024, 5, 2), dt.date(2024, 5, 1)),
                                   ("a", "r3", dt.date(2024, 5, 9), dt.date(2024, 5, 1))], "athlete_id string, source_file string, day date, month date")
    nights = spark.createDataFrame([("a", "2024-05-01", 60), ("a", "2024-05-08", 90), ("a", "2024-05-02", 10), ("a", None, 1)],
                                   "athlete_id string, calendar_date string, score_overall int")
    assert K.monthly_sleep(rides, nights).first().sleep_score == 70.0


def test_undetermined_systems_take_the_smallest_solution(spark):
    cases = [[(1.0, 2.0), (1.0, 2.0)], [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], [(1.0, 0.0), (2.0, 0.0), (2.0, 0.0)], [(0.0, 3.0), (0.0, 3.0), (0.0, 3.0)],
             [(1.0, 2.0), (2.0, 1.0), (4.0, 4.0)], [(1.0, 5.0), (1.0, 7.0), (1.0, 9.0)]]
    rnd = random.Random(1)
    for points in cases:
        y = [rnd.uniform(-5, 5) for _ in points]
        x = np.column_stack([np.ones(len(points)), np.array(points)])
        c = x[:, 1:] - x[:, 1:].mean(axis=0)
        s = c.T @ c
        t = c.T @ np.array(y)
        values = [s[0, 0], s[0, 1], s[1, 1], t[0], t[1], *x[:, 1:].mean(axis=0), sum(y) / len(y)]
        sums = spark.createDataFrame([tuple(float(v) for v in values)], ", ".join(f"{c} double" for c in "s11 s12 s22 s1y s2y a1 a2 ybar".split()))
        got = K.smallest_solution(sums).select("b0", "b1", "b2").first()
        want, *_ = np.linalg.lstsq(x, np.array(y), rcond=None)
        assert list(got) == pytest.approx(list(want), abs=1e-9)
