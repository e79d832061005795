"""Survey estimates against hand-worked answers and invariants."""

import math

import numpy as np
import pytest

from tallywork.errors import Refusal
from tallywork.operators import means as m
from tallywork.operators import survey as s


@pytest.fixture(scope="module")
def hand(spark):
    rows = [(10.0 * (i + 1), 1.0 if i < 3 else 3.0, "ab"[i % 2]) for i in range(6)]
    return spark.createDataFrame(rows, "spend double, weight double, region string")


def test_hand_worked_mean(hand):
    row = s.weighted_mean(hand, "spend", "weight").first()
    assert row["weighted_mean"] == pytest.approx(42.5) and row["unweighted_mean"] == pytest.approx(35.0)
    assert row["standard_error"] ** 2 == pytest.approx(6 / 5 * 5037.5 / 144)
    assert row["dof"] == 5
    assert row["ci95_high"] - 42.5 == pytest.approx(2.5705818356 * row["standard_error"], rel=1e-8)


def test_hand_worked_total_and_quantile(hand):
    assert s.weighted_total(hand, "spend", "weight").first()["standard_error"] ** 2 == pytest.approx(32820.0)
    row = s.weighted_quantile(hand, "spend", "weight").first()
    assert row["weighted_quantile"] == 40.0 and row["unweighted_quantile"] == 30.0


def test_equal_weights_change_nothing(spark):
    rows = [(float(v), 4.0, g) for g, vs in (("a", (3, 5, 8, 9)), ("b", (1, 2, 2, 7))) for v in vs]
    df = spark.createDataFrame(rows, "score double, weight double, arm string")
    w = s.weighted_mean(df, "score", "weight").first()
    plain = m.mean_ci(df, "score").first()
    assert w["weighted_mean"] == pytest.approx(plain["mean"])
    assert w["standard_error"] == pytest.approx(plain["sd"] / math.sqrt(8))
    assert (w["ci95_low"], w["ci95_high"]) == pytest.approx((plain["ci95_low"], plain["ci95_high"]))
    d = s.design_effect(df, "score", "weight").first()
    assert d["design_effect_kish"] == pytest.approx(1.0) and d["effective_sample_size"] == pytest.approx(8.0)


def survey_rows(weights):
    rng = np.random.default_rng(0)
    out = []
    for i in range(200):
        out.append((["f", "m"][int(rng.integers(2))], ["no", "yes", "unsure"][int(rng.integers(3))], weights(rng)))
    return out


def test_rao_scott_is_one_under_equal_weights(spark):
    df = spark.createDataFrame(survey_rows(lambda rng: 2.5), "gender string, answer string, weight double")
    row = s.weighted_crosstab(df, "gender", "answer", "weight").first()
    assert row["correction_factor"] == pytest.approx(1.0)
    assert row["statistic"] == pytest.approx(row["uncorrected_statistic"])


def test_rao_scott_matches_direct_indicators(spark):
    rows = survey_rows(lambda rng: float(rng.uniform(0.5, 4)))
    df = spark.createDataFrame(rows, "gender string, answer string, weight double")
    g, a, w = (np.array(c) for c in zip(*rows))
    n, total = len(w), w.sum()

    def term(z):
        p = (w * z).sum() / total
        u = w * (z - p) / total
        var = n / (n - 1) * ((u - u.mean()) ** 2).sum()
        return (1 - p) * var / (p * (1 - p) / (n - 1))

    cells = sum(term((g == x) & (a == y)) for x in set(g) for y in set(a))
    margins = sum(term(g == x) for x in set(g)) + sum(term(a == y) for y in set(a))
    got = s.weighted_crosstab(df, "gender", "answer", "weight").first()
    assert got["correction_factor"] == pytest.approx((cells - margins) / 2, rel=1e-9)


def test_woodruff_interval_matches_direct(spark):
    rng = np.random.default_rng(3)
    y, w = np.round(rng.lognormal(3, 1, 150), 1), rng.uniform(0.5, 3, 150)
    h, c = np.arange(150) % 3, np.arange(150) % 15
    df = spark.createDataFrame(
        [(float(a), float(b), str(p), str(q)) for a, b, p, q in zip(y, w, h, c)], "y double, w double, h string, c string")
    order = np.argsort(y, kind="stable")
    inverse = lambda p: y[order][min(np.searchsorted(np.cumsum(w[order]), p * w.sum(), side="left"), 149)]
    q = inverse(0.5)
    z = (y <= q) * 1.0
    u = w * (z - (w * z).sum() / w.sum()) / w.sum()
    var = 0.0
    for stratum in range(3):
        t = np.array([u[(h == stratum) & (c == unit)].sum() for unit in sorted(set(c[h == stratum]))])
        var += t.size / (t.size - 1) * ((t - t.mean()) ** 2).sum()
    from tallywork.functions.dist import t_point
    half = t_point(0.975, 12) * math.sqrt(var)
    row = s.weighted_quantile(df, "y", "w", 0.5, strata="h", cluster="c").first()
    assert (row["weighted_quantile"], row["dof"]) == (q, 12)
    assert (row["ci95_low"], row["ci95_high"]) == (inverse(0.5 - half), inverse(0.5 + half))


def test_refusals(spark, hand):
    with pytest.raises(Refusal, match="negative"):
        s.weighted_mean(hand.selectExpr("spend", "weight - 2 AS weight"), "spend", "weight")
    with pytest.raises(Refusal, match="1 respondent"):
        s.weighted_mean(hand.selectExpr("spend", "weight", "CAST(spend = 10 AS STRING) AS h"), "spend", "weight", strata="h")
    with pytest.raises(Refusal, match="second role"):
        s.weighted_mean(hand, "weight", "weight")


def test_zero_weights_leave_and_are_counted(spark, hand):
    more = hand.unionByName(spark.createDataFrame([(999.0, 0.0, "a"), (None, 1.0, "b")], hand.schema))
    d = s.survey_prepare(more, "spend", "weight")
    assert (d.n, d.n_excluded) == (6, 2)
    assert s.weighted_mean(more, "spend", "weight").first()["weighted_mean"] == pytest.approx(42.5)
