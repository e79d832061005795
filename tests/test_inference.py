"""Hand-computed answers for tests on means, ranks, counts and pairs of columns."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tallywork.errors import Refusal
from tallywork.operators import bivariate as b
from tallywork.operators import counts as c
from tallywork.operators import means as m
from tallywork.operators import ranks as r


@pytest.fixture(scope="module")
def two(spark):
    rows = [("A", float(v)) for v in (10, 12, 14, 16, 18)] + [("B", float(v)) for v in (20, 22, 24, 26, 28)]
    return spark.createDataFrame(rows, "grp string, score double")


@pytest.fixture(scope="module")
def three(spark):
    step = math.sqrt(20)
    rows = [(g, mean + e) for g, mean in (("a", -step), ("b", 0.0), ("c", step)) for e in (-5.0, 0.0, 0.0, 0.0, 5.0)]
    return spark.createDataFrame(rows, "grp string, score double")


def test_welch_and_pooled(two):
    for pooled in (False, True):
        row = m.ttest_independent(two, "score", "grp", equal_var=pooled).first()
        assert (row["group1"], row["group2"]) == ("A", "B")
        assert row["statistic"] == pytest.approx(-5.0)
        assert row["dof"] == pytest.approx(8.0)
        assert row["p_value"] == pytest.approx(0.0010528257933665, rel=1e-8)
        assert row["ci95_high"] == pytest.approx(-10 + 2.3060041350 * 2, rel=1e-8)
        assert row["cohens_d"] == pytest.approx(-10 / math.sqrt(10))
        assert row["hedges_g"] == pytest.approx(-10 / math.sqrt(10) * (1 - 3 / 31))
    one_sided = m.ttest_independent(two, "score", "grp", alternative="less").first()
    assert one_sided["p_value"] == pytest.approx(0.0010528257933665 / 2, rel=1e-8)


def test_one_sample(two):
    row = m.ttest_one_sample(two.where("grp = 'A'"), "score", 10).first()
    assert row["statistic"] == pytest.approx(2.8284271247)
    assert row["cohens_d"] == pytest.approx(1.2649110641)
    assert row["ci95_high"] - row["mean"] == pytest.approx(2.7764451052 * math.sqrt(2), rel=1e-9)


def test_segments_run_in_one_frame(spark):
    rows = [(s, g, float(v + 10 * (g == "B") * (s == "x"))) for s in "xy" for g in "AB" for v in (10, 12, 14, 16, 18)]
    df = spark.createDataFrame(rows, "seg string, grp string, score double")
    got = {x["seg"]: x for x in m.ttest_independent(df, "score", "grp", by=["seg"]).collect()}
    assert got["x"]["statistic"] == pytest.approx(-5.0) and got["y"]["statistic"] == pytest.approx(0.0)


def test_refusals(spark, two, three):
    with pytest.raises(PySparkException, match="exactly two groups"):
        m.ttest_independent(three, "score", "grp").collect()
    with pytest.raises(Refusal):
        m.ttest_one_sample(two, "score", 0, alternative="sideways")
    lonely = two.unionByName(spark.createDataFrame([("C", 1.0)], two.schema))
    with pytest.raises(PySparkException, match="two values"):
        m.anova(lonely, "score", "grp").collect()
    same = spark.createDataFrame([(1.0, 1.0)] * 4, "a double, b double")
    with pytest.raises(PySparkException, match="identical"):
        r.wilcoxon(same, "a", "b").collect()


def test_anova(three):
    row = m.anova(three, "score", "grp").first()
    assert row["test"] == "classic"
    assert row["statistic"] == pytest.approx(8.0)
    assert (row["dof_between"], row["dof_within"]) == (2, 12)
    assert row["p_value"] == pytest.approx((1 + 16 / 12) ** -6, rel=1e-9)
    assert row["eta_squared"] == pytest.approx(4 / 7)
    assert row["omega_squared"] == pytest.approx(35 / 72.5)


def test_unequal_spread_switches_to_welch(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(60)] + [("b", rng.gauss(0, 30)) for _ in range(60)]
    row = m.anova(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()
    t = m.ttest_independent(spark.createDataFrame(rows, "g string, x double"), "x", "g").first()
    assert row["test"] == "welch" and row["equal_variance"] is False
    assert row["statistic"] == pytest.approx(t["statistic"] ** 2)  # two groups: F = t²
    assert row["p_value"] == pytest.approx(t["p_value"], rel=1e-8)


def test_tukey_of_two_groups_is_the_pooled_t_test(two):
    row = m.tukey_hsd(two, "score", "grp").first()
    assert row["p_value"] == pytest.approx(0.0010528257933665, rel=1e-5)
    assert row["difference"] == pytest.approx(-10.0)


def test_group_of_one_leaves_the_test_only(spark):
    rows = [("A", float(v)) for v in range(6)] + [("B", float(v + 3)) for v in range(6)] + [("C", 99.0)]
    df = spark.createDataFrame(rows, "segment string, spend double")
    table = {x["segment"]: x for x in b.group_comparison(df, "spend", "segment").collect()}
    assert table["C"]["n"] == 1 and table["C"]["ci95_low"] is None
    row = b.group_comparison_test(df, "spend", "segment").first()
    assert row["test"] == "welch_t" and row["n"] == 12 and row["n_groups_dropped"] == 1
    assert row["statistic"] == pytest.approx(-3 / math.sqrt(3.5 / 6 * 2))


def test_shapiro_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    w, p = m.shapiro(weights)
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=5e-4)
    df = spark.createDataFrame([(float(x),) for x in weights], "x double")
    row = m.normality_test(df, "x").first()
    assert row["p_value"] == pytest.approx(p) and row["normal"] is False and row["mean_robust"] is False


def test_dagostino_on_normal_and_skewed(spark, monkeypatch):
    monkeypatch.setattr(m, "SHAPIRO_MAX", 100)
    rng = random.Random(5)
    rows = [("n", rng.gauss(0, 1)) for _ in range(2000)] + [("e", rng.expovariate(1)) for _ in range(2000)]
    got = {x["g"]: x for x in m.normality_test(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert got["n"]["test"] == "dagostino" and got["n"]["p_value"] > 0.01
    assert got["e"]["p_value"] < 1e-20


# ------------------------------------------------------------------------------- ranks


def test_mannwhitney_exact(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3)] + [("b", float(v)) for v in (4, 5, 6)], "g string, x double")
    row = r.mannwhitney(df, "x", "g").first()
    assert row["method"] == "exact" and row["statistic"] == 0.0
    assert row["p_value"] == pytest.approx(0.1)
    assert row["rank_biserial"] == pytest.approx(-1.0)
    assert r.mannwhitney(df, "x", "g", alternative="less").first()["p_value"] == pytest.approx(0.05)


def test_mannwhitney_normal_with_ties(spark):
    rng = random.Random(3)
    a, bb = [rng.randint(0, 9) for _ in range(40)], [rng.randint(2, 11) for _ in range(50)]
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in bb], "g string, x double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in bb)
    n = 90
    ties = sum(t**3 - t for t in ((a + bb).count(v) for v in set(a + bb)))
    sd = math.sqrt(40 * 50 / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (max(u, 2000 - u) - 1000 - 0.5) / sd
    row = r.mannwhitney(df, "x", "g").first()
    assert row["statistic"] == pytest.approx(u)
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("n1, n2", [(1, 1), (2, 3), (7, 40), (30, 31)])
def test_hodges_lehmann_brute_force(spark, n1, n2):
    rng = random.Random(n1 * 100 + n2)
    a, bb = [round(rng.gauss(0, 5), 1) for _ in range(n1)], [round(rng.gauss(2, 5), 1) for _ in range(n2)]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in bb], "g string, x double").repartition(3)
    want = float(np.median([x - y for x in a for y in bb]))
    assert r.hodges_lehmann(df, "x", "g").first()["shift"] == pytest.approx(want)


@pytest.mark.parametrize("kind", ["smooth", "ties", "wild"])
def test_hodges_lehmann_in_many_ranges(spark, monkeypatch, kind):
    """Both sides are cut in ranges; values repeat, or lie many powers of ten apart."""
    monkeypatch.setattr(r, "SIDE_ROWS", 40)
    monkeypatch.setattr(r, "STEPS", 6)
    rng = random.Random(kind)
    draw = {"smooth": lambda: rng.gauss(0, 5), "ties": lambda: float(rng.choice([0, 0, 0, 1, 2, 3.5, rng.randint(0, 300)])),
            "wild": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9)}[kind]
    a, bb = [draw() for _ in range(300)], [draw() + 1 for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in bb], "g string, x double").repartition(3)
    want = float(np.median(np.subtract.outer(a, bb)))
    assert r.hodges_lehmann(df, "x", "g").first()["shift"] == pytest.approx(want, rel=1e-12)


def test_hodges_lehmann_counts_weighted_pairs(spark):
    """A hundred thousand copies on either side are one value each: 10^10 pairs."""
    rows = spark.range(200_001).selectExpr(
        "CASE WHEN id < 100000 THEN 'a' ELSE 'b' END AS g", "CASE WHEN id < 99990 THEN 7.0 WHEN id < 100000 THEN id WHEN id < 200000 THEN 4.5 ELSE -3.0 END AS x")
    row = r.hodges_lehmann(rows, "x", "g").first()
    assert (row["n1"], row["n2"], row["shift"]) == (100_000, 100_001, 2.5)


def test_mannwhitney_exact_with_a_long_second_sample(spark):
    """Three against three thousand: the p-value counts all triples of ranks."""
    few = [10.5, 2900.5, 2999.5]
    df = spark.createDataFrame([("a", v) for v in few] + [("b", float(v)) for v in range(3000)], "g string, x double")
    row = r.mannwhitney(df, "x", "g", alternative="greater").first()
    u, n = int(row["statistic"]), 3000
    below = 0  # partitions of at most u - 1 into three parts of at most n
    for a in range(min(n, u - 1) + 1):
        b = np.arange(0, min(a, u - 1 - a) + 1)
        below += int(np.maximum(0, np.minimum(b, u - 1 - a - b) + 1).sum())
    assert row["method"] == "exact" and row["p_value"] == pytest.approx(1 - below / math.comb(n + 3, 3), rel=1e-9)


def test_wilcoxon(spark):
    df = spark.createDataFrame([(float(v), 0.0) for v in (1, 2, 3, 4, 5)], "a double, b double")
    row = r.wilcoxon(df, "a", "b").first()
    assert row["method"] == "exact" and row["p_value"] == pytest.approx(2 / 32)
    with_zero = spark.createDataFrame([(3.0, 3.0), (5.0, 1.0), (1.0, 4.0), (9.0, 2.0), (None, 1.0)], "a double, b double")
    row = r.wilcoxon(with_zero, "a", "b").first()
    assert (row["n_pairs"], row["n_tied"], row["n_complete"]) == (3, 1, 4)
    assert (row["w_plus"], row["w_minus"]) == (5.0, 1.0)


def test_kruskal_without_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0), ("c", 5.0), ("c", 6.0)], "g string, x double")
    row = r.kruskal(df, "x", "g").first()
    h = 12 / (6 * 7) * (9 / 2 + 49 / 2 + 121 / 2) - 3 * 7
    assert row["statistic"] == pytest.approx(h) and row["p_value"] == pytest.approx(math.exp(-h / 2))


def tau_b(x, y):
    num = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        num += s
        tx += x[i] != x[j]
        ty += y[i] != y[j]
    return num / math.sqrt(tx * ty)


@pytest.mark.parametrize("span, hot", [(1000, False), (6, False), (40, True)])
def test_kendall_brute_force(spark, span, hot):
    rng = random.Random(span)
    x = [rng.randint(0, span) for _ in range(400)]
    y = [v // 2 + rng.randint(0, span) for v in x]
    if hot:  # one value holds a third of the rows
        x = [7 if i % 3 == 0 else v for i, v in enumerate(x)]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double").repartition(4)
    assert b.kendall(df, "x", "y").first()["r"] == pytest.approx(tau_b(x, y), rel=1e-12)


def test_kendall_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(b, "BLOCK_ROWS", 13)
    rng = random.Random(77)
    x = [7 if i % 3 == 0 else rng.randint(0, 60) for i in range(500)]
    y = [v // 2 + rng.randint(0, 50) for v in x]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double").repartition(4)
    assert b.kendall(df, "x", "y").first()["r"] == pytest.approx(tau_b(x, y), rel=1e-12)


def test_kendall_exact_for_one_discordant_pair_of_many(spark):
    y = list(range(40))
    y[10], y[11] = y[11], y[10]
    df = spark.createDataFrame([(float(i), float(v)) for i, v in enumerate(y)], "x double, y double")
    row = b.kendall(df, "x", "y").first()
    assert row["r"] == pytest.approx(1 - 4 / (40 * 39)) and row["p_value"] == pytest.approx(2 / math.factorial(39), rel=1e-9)


def test_tukey_has_no_cap_on_groups(spark):
    df = spark.range(3000).selectExpr("id % 250 AS g", "(id * 7919 % 101) * 1.0 AS x")
    assert m.tukey_hsd(df, "x", "g").select("q").count() == 250 * 249 // 2


# ------------------------------------------------------------------------------ counts


@pytest.fixture(scope="module")
def square(spark):
    cells = [("a", "n", 10), ("a", "y", 20), ("b", "n", 30), ("b", "y", 10)]
    return spark.createDataFrame([(x, o) for x, o, k in cells for _ in range(k)], "arm string, outcome string")


def test_chi_square(square):
    row = c.chi_square_independence(square, "arm", "outcome").first()
    assert row["chi2_uncorrected"] == pytest.approx(12.152778, rel=1e-6)
    assert row["statistic"] == pytest.approx(10.510938, rel=1e-6)
    assert row["cramers_v"] == pytest.approx(5 / 12)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(row["statistic"] / 2)), rel=1e-9)


def test_chi_square_with_an_empty_cell(spark):
    cells = [("a", "x", 5), ("b", "y", 7), ("c", "x", 3), ("c", "y", 4), ("a", "z", 2)]
    df = spark.createDataFrame([(p, q) for p, q, k in cells for _ in range(k)], "r string, c string")
    table = np.array([[5, 0, 2], [0, 7, 0], [3, 4, 0]], dtype=float)
    e = np.outer(table.sum(1), table.sum(0)) / table.sum()
    assert c.chi_square_independence(df, "r", "c").first()["statistic"] == pytest.approx(((table - e) ** 2 / e).sum())
    assert c.expected_counts(df, "r", "c").count() == 9


def test_uncorrected_chi_square_is_z_squared(square):
    z = c.proportion_test_two(square, "outcome", "y", "arm").first()
    assert z["statistic"] ** 2 == pytest.approx(12.152778, rel=1e-6)
    assert z["difference"] == pytest.approx(20 / 30 - 10 / 40)


def test_fisher_orientation(square):
    row = c.fisher_exact(square, "arm", "outcome").first()
    assert (row["row1"], row["column1"]) == ("a", "n")
    assert row["odds_ratio"] == pytest.approx(10 * 10 / (20 * 30))


def test_success_value_must_occur(square):
    with pytest.raises(Refusal, match="does not occur"):
        c.proportion_test(square, "outcome", "maybe", 0.5)


def test_wilson(spark):
    df = spark.createDataFrame([("y",)] * 8 + [("n",)] * 2, "o string")
    row = c.proportion_test(df, "o", "y", 0.5).first()
    assert row["ci95_low"] == pytest.approx(0.4901625, abs=1e-6)
    assert row["ci95_high"] == pytest.approx(0.9433178, abs=1e-6)


def test_benjamini_hochberg_against_the_definition(spark):
    rng = random.Random(11)
    ps = [rng.random() ** 3 for _ in range(300)] + [0.02] * 150 + [None] * 3
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p_value double").repartition(5)
    got = {x["i"]: x["p_adjusted"] for x in c.benjamini_hochberg(df).collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    low = 1.0
    for rank in range(len(known), 0, -1):
        p, i = known[rank - 1]
        low = min(low, p * len(known) / rank)
        assert got[i] == pytest.approx(low)
    assert all(got[i] is None for i, p in enumerate(ps) if p is None)
