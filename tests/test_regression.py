"""Regression against closed forms and direct numeric solutions on small frames."""

import math
import random

import numpy as np
import pytest

from tallywork.errors import Refusal
from tallywork.operators import bivariate, regression as r


def by_term(fit):
    return {row["term"]: row.asDict() for row in fit.coefficients.collect()}


@pytest.fixture(scope="module")
def linear(spark):
    rows = []
    for i in range(60):
        x1, x2 = (i % 10) - 4.5, float((i * 7) % 11)
        rows.append((i, x1, x2, 3 + 2 * x1 - 1.5 * x2 + 0.4 * math.cos(3 * i), "nse"[i % 3]))
    return spark.createDataFrame(rows, "i int, x1 double, x2 double, y double, region string")


def numpy_ols(rows, robust):
    x = np.array([[1, a["x1"], a["x2"], a["region"] == "n", a["region"] == "s"] for a in rows], dtype=float)
    y = np.array([a["y"] for a in rows])
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    e = y - x @ b
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    n, p = x.shape
    w = {"none": None, "HC0": e**2, "HC1": e**2 * n / (n - p), "HC2": e**2 / (1 - h), "HC3": e**2 / (1 - h) ** 2}[robust]
    cov = inv * (e @ e) / (n - p) if w is None else inv @ (x.T * w) @ x @ inv
    return b, np.sqrt(np.diag(cov)), e, h


@pytest.mark.parametrize("robust", r.ROBUST)
def test_ols_matches_direct_solution(linear, robust):
    fit = r.ols(linear, "y", ["x1", "x2", "region"], robust=robust)
    got = by_term(fit)
    b, se, e, h = numpy_ols(linear.collect(), robust)
    for k, term in enumerate(["(Intercept)", "x1", "x2", "region[n]", "region[s]"]):
        assert got[term]["coefficient"] == pytest.approx(b[k], rel=1e-9)
        assert got[term]["std_error"] == pytest.approx(se[k], rel=1e-8)
    s = fit.summary.first()
    p, n = 5, 60
    cook = e**2 / (p * (e @ e) / (n - p)) * h / (1 - h) ** 2
    assert s["max_cook"] == pytest.approx(cook.max(), rel=1e-6)
    assert s["influential_share"] == pytest.approx((cook > 4 / n).mean())
    assert s["dof_resid"] == 55


def test_durbin_watson_and_breusch_pagan(linear):
    rows = sorted(linear.collect(), key=lambda a: a["i"])
    x = np.array([[1, a["x1"]] for a in rows])
    y = np.array([a["y"] for a in rows])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    got = r.durbin_watson(linear.repartition(7), "y", ["x1"], "i").first()["statistic"]
    assert got == pytest.approx((np.diff(e) ** 2).sum() / (e @ e), rel=1e-9)
    e2 = e**2
    fit = x @ np.linalg.lstsq(x, e2, rcond=None)[0]
    lm = 60 * (1 - ((e2 - fit) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum())
    assert r.breusch_pagan(linear, "y", ["x1"]).first()["statistic"] == pytest.approx(lm, rel=1e-8)


def test_orthogonal_regressors_have_vif_one(spark):
    df = spark.createDataFrame([(float(i % 2), float(i // 2 % 2), float(i)) for i in range(40)], "x1 double, x2 double, y double")
    assert [x["vif"] for x in r.vif(df, ["x1", "x2"]).collect()] == pytest.approx([1.0, 1.0])


def test_refusals(spark, linear):
    with pytest.raises(Refusal, match="perfect"):
        r.ols(linear.selectExpr("x1", "2 * x1 + 1 AS y"), "y", ["x1"])
    with pytest.raises(Refusal, match="collinear"):
        r.ols(linear.selectExpr("x1", "3 * x1 AS x3", "y"), "y", ["x1", "x3"])
    with pytest.raises(Refusal, match="constant"):
        r.ols(linear.selectExpr("1.0D AS c", "y"), "y", ["c"])
    with pytest.raises(Refusal, match="cannot also be"):
        r.ols(linear, "y", ["y"])
    with pytest.raises(Refusal, match="levels"):
        r.ols(linear.selectExpr("CAST(i AS STRING) AS many", "y"), "y", ["many"])
    separable = spark.createDataFrame([(float(i), "yes" if i >= 20 else "no") for i in range(40)], "x double, outcome string")
    with pytest.raises(Refusal, match="separated|converge"):
        r.logit(separable, "outcome", ["x"], "yes")


def test_logit_2x2(spark):
    cells = [("a", "yes", 30), ("a", "no", 20), ("b", "yes", 10), ("b", "no", 40)]
    df = spark.createDataFrame([(g, o) for g, o, k in cells for _ in range(k)], "arm string, outcome string")
    fit = r.logit(df, "outcome", ["arm"], "yes")
    got = by_term(fit)
    assert got["(Intercept)"]["coefficient"] == pytest.approx(math.log(1.5))
    assert got["arm[b]"]["coefficient"] == pytest.approx(math.log(1 / 6))
    assert got["arm[b]"]["std_error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 20 + 1 / 10 + 1 / 40))
    assert got["arm[b]"]["odds_ratio"] == pytest.approx(1 / 6)
    s = fit.summary.first()
    like = 30 * math.log(0.6) + 20 * math.log(0.4) + 10 * math.log(0.2) + 40 * math.log(0.8)
    assert s["log_likelihood"] == pytest.approx(like) and s["events_per_predictor"] == 40


def test_poisson_two_groups(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (2, 4, 6)] + [("b", float(v)) for v in (10, 14, 12)], "g string, y double")
    got = by_term(r.count_model(df, "y", ["g"]))
    assert got["g[b]"]["irr"] == pytest.approx(3.0)
    assert got["g[b]"]["std_error"] == pytest.approx(math.sqrt(1 / 12 + 1 / 36))
    check = r.dispersion_check(df, "y", ["g"]).first()
    assert check["pearson_chi2"] == pytest.approx(8 / 4 + 8 / 12)


def nb_loglik(rows, b0, b1, alpha):
    total = 0.0
    for g, y in rows:
        mu, s = math.exp(b0 + b1 * (g == "b")), 1 / alpha
        total += math.lgamma(y + s) - math.lgamma(s) - math.lgamma(y + 1) + s * math.log(s / (s + mu)) + y * math.log(mu / (s + mu))
    return total


def test_negative_binomial_is_at_the_maximum(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.poisson(m * rng.gamma(2.0, 0.5)))) for g, m in (("a", 3.0), ("b", 7.0)) for _ in range(150)]
    fit = r.count_model(spark.createDataFrame(rows, "g string, y double"), "y", ["g"], "negative_binomial")
    got, s = by_term(fit), fit.summary.first()
    b0, b1, alpha = got["(Intercept)"]["coefficient"], got["g[b]"]["coefficient"], s["alpha"]
    best = nb_loglik(rows, b0, b1, alpha)
    assert s["log_likelihood"] == pytest.approx(best, rel=1e-9)
    for d in (-0.01, 0.01):
        assert nb_loglik(rows, b0 + d, b1, alpha) < best
        assert nb_loglik(rows, b0, b1 + d, alpha) < best
        assert nb_loglik(rows, b0, b1, alpha * (1 + d)) < best
    # errors from a numeric second derivative
    h = 1e-4
    grid = lambda *d: nb_loglik(rows, b0 + d[0], b1 + d[1], alpha + d[2])
    hess = np.empty((3, 3))
    for i in range(3):
        for j in range(3):
            u, v = np.eye(3)[i] * h, np.eye(3)[j] * h
            hess[i, j] = (grid(*(u + v)) - grid(*(u - v)) - grid(*(v - u)) + grid(*(-u - v))) / (4 * h * h)
    se = np.sqrt(np.diag(np.linalg.inv(-hess)))
    assert got["g[b]"]["std_error"] == pytest.approx(se[1], rel=1e-3)
    assert s["alpha_se"] == pytest.approx(se[2], rel=1e-3)


def check_loss(rows, beta, tau):
    e = np.array([y - beta[0] - beta[1] * x for x, y in rows])
    return float((e * (tau - (e < 0))).sum())


@pytest.mark.parametrize("middle", [20_000, 60])
@pytest.mark.parametrize("tau", [0.5, 0.9])
def test_quantile_regression_reaches_the_best_vertex(spark, monkeypatch, tau, middle):
    monkeypatch.setattr(r, "MIDDLE_ROWS", middle)
    rng = random.Random(2)
    rows = [(round(rng.uniform(0, 10), 3), 0.0) for _ in range(300)]
    rows = [(x, round(2 + 3 * x + rng.expovariate(1) * (1 + x / 5), 4)) for x, _ in rows]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    got = by_term(r.quantile_regression(df, "y", ["x"], tau))
    beta = [got["(Intercept)"]["coefficient"], got["x"]["coefficient"]]
    best = check_loss(rows, beta, tau)
    # an optimum passes through two points: no line through two points does better
    pick = sorted(rows, key=lambda p: abs(p[1] - beta[0] - beta[1] * p[0]))[:25]
    for i, (x1, y1) in enumerate(pick):
        for x2, y2 in pick[i + 1:]:
            if x1 != x2:
                b = (y2 - y1) / (x2 - x1)
                assert check_loss(rows, [y1 - b * x1, b], tau) >= best - 1e-7
    assert abs(pick[0][1] - beta[0] - beta[1] * pick[0][0]) < 1e-8
    assert abs(pick[1][1] - beta[0] - beta[1] * pick[1][0]) < 1e-8


def test_quantile_regression_exact_line(spark):
    # symmetric noise that is zero for a third of the rows: the median line is exact
    rows = [(i % 20 + 0.0, 2 + 3.0 * (i % 20) + (0.0, 1.0, -1.0)[i % 3]) for i in range(240)]
    got = by_term(r.quantile_regression(spark.createDataFrame(rows, "x double, y double"), "y", ["x"], 0.5))
    assert got["(Intercept)"]["coefficient"] == pytest.approx(2.0) and got["x"]["coefficient"] == pytest.approx(3.0)


def test_gamma_differences(spark):
    """Whole counts have finite sums; r reaches from strong to hardly any extra dispersion."""
    from pyspark.sql import functions as F
    from tallywork.operators import likelihood as lk

    rows = [(float(y), r) for y in (0, 1, 2, 7, 40, 3000) for r in (1e-3, 0.4, 1.0, 5.5, 90.0, 1e4, 1e8)]
    y, r_ = F.col("y"), F.col("r")
    got = spark.createDataFrame(rows, "y double, r double").select(
        "y", "r", lk.lgamma_rise(y, r_).alias("l"), lk.digamma_rise(y, r_).alias("d"),
        lk.trigamma_rise(y, r_).alias("t")).collect()
    for row in got:
        steps = [row["r"] + j for j in range(int(row["y"]))]
        assert row["l"] == pytest.approx(math.fsum(math.log(v) for v in steps), rel=1e-11, abs=1e-9)
        assert row["d"] == pytest.approx(math.fsum(1 / v for v in steps), rel=1e-10, abs=1e-15)
        assert row["t"] == pytest.approx(-math.fsum(1 / v**2 for v in steps), rel=1e-9, abs=1e-19)


def test_negative_binomial_without_extra_dispersion_is_refused(spark):
    rows = [("ab"[i % 2], float(3 + i % 2 + i % 3)) for i in range(200)]
    with pytest.raises(Refusal, match="Poisson family"):
        r.count_model(spark.createDataFrame(rows, "g string, y double"), "y", ["g"], "negative_binomial")


def test_scatter_of_many_groups(spark):
    rows = [(f"g{g}", float(i), g * i + 1.0) for g in range(40) for i in range(5)] + [(None, 1.0, 2.0), ("g1", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["group"]: r for r in bivariate.scatter_with_fit(df, "x", "y", "g").collect()}
    assert len(got) == 42 and got["(all)"]["n"] == 201 and got["(missing)"]["n"] == 1
    assert all(got[f"g{g}"]["slope"] == pytest.approx(g) and got[f"g{g}"]["n"] == 5 for g in range(40))
    assert got["g7"]["p_value"] == pytest.approx(0, abs=1e-9) and got["g0"]["p_value"] is got["(missing)"]["p_value"] is None
    with pytest.raises(Refusal, match="more than 12 groups"):
        bivariate.scatter_with_fit(df, "x", "y", "g", max_groups=12)
