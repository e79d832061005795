"""Tests on means. Every test takes ``by``: one row of results per segment, in one job.

Without segments an impossible request fails the query with its reason; with segments the
segment's statistics are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import number, quoted
from tallywork.functions.dist import norm_point, norm_upper
from tallywork.operators.ordering import grouped_quantiles, join_groups
from tallywork.session import cut_lineage

ALPHA = 0.05


def refuse(bad: Column, reason: str, by: list[str], value: Column) -> Column:
    """``value``, unless ``bad``: then the reason (one test) or null (many segments)."""
    stop = F.lit(None).cast("double") if by else F.raise_error(F.lit(reason)).cast("double")
    return F.when(bad, stop).otherwise(value)


def check_alternative(alternative: str) -> None:
    if alternative not in dist.ALTERNATIVES:
        raise Refusal(f"Unknown alternative: {alternative}. Supported: {dist.ALTERNATIVES}")


def labelled(df: DataFrame, group: str, column: str, by=()) -> DataFrame:
    """Complete rows as (by, g, x). Groups are told apart by their text form."""
    need_columns(df, [group, column, *by])
    return df.select(
        *by, quoted(group).cast("string").alias("g"), number(quoted(column)).alias("x")
    ).dropna()


def group_moments(rows: DataFrame, by=()) -> DataFrame:
    return rows.groupBy(*by, "g").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var")
    )


def with_mean_ci(df: DataFrame) -> DataFrame:
    """95 % t interval of a mean, from columns n, mean, sd."""
    margin = dist.t_ppf(F.lit(0.975), F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    known = (F.col("n") > 1) & (F.col("sd") > 0)
    return df.withColumn("_m", F.when(known, margin)).select(
        "*", (F.col("mean") - F.col("_m")).alias("ci95_low"),
        (F.col("mean") + F.col("_m")).alias("ci95_high"),
    ).drop("_m")


def group_summary(df: DataFrame, column: str, group_by: str, by=()) -> DataFrame:
    """n, mean, sd, median and a t interval per group."""
    by = list(by)
    rows = labelled(df, group_by, column, by)
    stats = group_moments(rows, by).withColumn("sd", F.sqrt("var")).drop("var")
    medians = grouped_quantiles(rows, "x", {"median": 0.5}, [*by, "g"])
    return with_mean_ci(stats.join(medians, [*by, "g"])).withColumnRenamed("g", group_by)


def mean_ci(df: DataFrame, column: str, by=()) -> DataFrame:
    x = number(quoted(column))
    stats = df.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    return with_mean_ci(stats)


# ----------------------------------------------------------------------------- t-tests


def ttest_one_sample(df, column, mu, alternative="two-sided", by=()) -> DataFrame:
    check_alternative(alternative)
    need_columns(df, [column, *by])
    stats = mean_ci(df, column, by).withColumn("dof", F.col("n") - 1)
    few = F.col("n") < 2
    t = (F.col("mean") - F.lit(float(mu))) / (F.col("sd") / F.sqrt("n"))
    stats = stats.withColumn(
        "statistic", refuse(few, f"ttest: too few non-null values in '{column}'", list(by), t))
    return stats.select(
        *by, "n", "mean", "sd", "statistic", "dof",
        dist.t_p_value(F.col("statistic"), F.col("dof"), alternative).alias("p_value"),
        (F.col("mean") - mu).alias("mean_difference"), "ci95_low", "ci95_high",
        ((F.col("mean") - mu) / F.col("sd")).alias("cohens_d"),
    )


def two_groups(moments: DataFrame, by: list[str], test: str) -> DataFrame:
    """The two groups side by side, in label order; any other number is refused."""
    row = moments.groupBy(*by).agg(
        F.count("*").alias("k"), F.min("g").alias("group1"), F.max("g").alias("group2"),
        *[F.min_by(c, "g").alias(f"{c}1") for c in ("n", "mean", "var")],
        *[F.max_by(c, "g").alias(f"{c}2") for c in ("n", "mean", "var")],
    )
    row = row.withColumn("_ok", refuse(
        F.col("k") != 2, f"{test}: needs exactly two groups", by, F.lit(1.0)))
    return row.withColumn("_ok", refuse(
        (F.col("n1") < 2) | (F.col("n2") < 2), f"{test}: every group needs two values", by,
        F.col("_ok")))


def cohens_d(row: DataFrame) -> DataFrame:
    """Pooled-deviation difference and its small-sample correction."""
    pooled = F.expr("((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)")
    d = (F.col("mean1") - F.col("mean2")) / F.sqrt(F.when(pooled > 0, pooled))
    return row.withColumn("cohens_d", d).withColumn(
        "hedges_g", F.expr("cohens_d * (1 - 3 / (4 * (n1 + n2) - 9))"))


def mean_difference(row: DataFrame, equal_var: bool) -> DataFrame:
    """Difference of two means with its standard error, dof and 95 % interval."""
    if equal_var:
        se2 = "((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)"
        dof = "CAST(n1 + n2 - 2 AS DOUBLE)"
    else:
        se2 = "var1 / n1 + var2 / n2"
        dof = ("power(var1 / n1 + var2 / n2, 2) / nullif(power(var1 / n1, 2) / (n1 - 1) "
               "+ power(var2 / n2, 2) / (n2 - 1), 0)")
    row = row.selectExpr("*", "mean1 - mean2 AS mean_difference", f"sqrt({se2}) AS se", f"{dof} AS dof")
    margin = dist.t_ppf(F.lit(0.975), F.col("dof")) * F.col("se")
    return row.withColumn("_m", margin).select(
        "*", (F.col("mean_difference") - F.col("_m")).alias("ci95_low"),
        (F.col("mean_difference") + F.col("_m")).alias("ci95_high")).drop("_m")


def ttest_independent(df, column, group_by, equal_var=False, alternative="two-sided", by=()):
    """Welch by default, pooled on request; first label minus second."""
    check_alternative(alternative)
    by = list(by)
    row = two_groups(group_moments(labelled(df, group_by, column, by), by), by, "ttest")
    row = cohens_d(mean_difference(row, equal_var))
    row = row.withColumn("statistic", F.col("_ok") * F.expr("mean_difference / nullif(se, 0)"))
    return row.select(
        *by, "group1", "group2", "n1", "n2", "mean_difference", "statistic", "dof",
        dist.t_p_value(F.col("statistic"), F.col("dof"), alternative).alias("p_value"),
        "ci95_low", "ci95_high", "cohens_d", "hedges_g",
    )


def complete_pairs(df, column, column2, by=()) -> DataFrame:
    need_columns(df, [column, column2, *by])
    return df.select(
        *by, number(quoted(column)).alias("a"), number(quoted(column2)).alias("b"))


def ttest_paired(df, column, column2, alternative="two-sided", by=()) -> DataFrame:
    check_alternative(alternative)
    pairs = complete_pairs(df, column, column2, by).withColumn("difference", F.expr("a - b"))
    n_rows = pairs.groupBy(*by).agg(
        F.count("difference").alias("n"), F.avg("difference").alias("mean"),
        F.stddev_samp("difference").alias("sd"), F.count("*").alias("_rows"))
    stats = with_mean_ci(n_rows).withColumn("dof", F.col("n") - 1)
    t = F.expr("mean / nullif(sd / sqrt(n), 0)")
    stats = stats.withColumn("statistic", refuse(
        F.col("n") < 2, "ttest: too few complete pairs", list(by), t))
    return stats.select(
        *by, "n", (F.col("_rows") - F.col("n")).alias("n_excluded"),
        F.col("mean").alias("mean_difference"), "statistic", "dof",
        dist.t_p_value(F.col("statistic"), F.col("dof"), alternative).alias("p_value"),
        "ci95_low", "ci95_high", F.expr("mean / nullif(sd, 0)").alias("cohens_d"),
    )


# ------------------------------------------------------------------------------- anova


def one_way(moments: DataFrame, by: list[str]) -> DataFrame:
    """Classic F and the sums of squares behind it, from one row per group."""
    whole = W.partitionBy(*by)
    centred = moments.withColumn(
        "_gm", F.sum(F.expr("n * mean")).over(whole) / F.sum("n").over(whole))
    sums = centred.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("smallest_group"),
        F.sum(F.expr("n * power(mean - _gm, 2)")).alias("ss_between"),
        F.sum(F.expr("(n - 1) * coalesce(var, 0)")).alias("ss_within"),
    )
    return sums.selectExpr(
        "*", "k - 1 AS dof_between", "n - k AS dof_within",
        "ss_between / nullif(k - 1, 0) / nullif(ss_within / nullif(n - k, 0), 0) AS statistic",
        "ss_between / nullif(ss_between + ss_within, 0) AS eta_squared",
        "(ss_between - (k - 1) * ss_within / nullif(n - k, 0)) / "
        "nullif(ss_between + ss_within + ss_within / nullif(n - k, 0), 0) AS omega_squared",
    )


def welch(moments: DataFrame, by: list[str]) -> DataFrame:
    """Variance-weighted F with Satterthwaite-Welch denominator degrees of freedom."""
    whole = W.partitionBy(*by)
    w = moments.withColumn("w", F.expr("n / nullif(var, 0)"))
    w = w.withColumn("_tw", F.sum("w").over(whole)).withColumn(
        "_wm", F.sum(F.expr("w * mean")).over(whole) / F.col("_tw"))
    sums = w.groupBy(*by).agg(
        F.count("*").alias("k"),
        F.sum(F.expr("w * power(mean - _wm, 2)")).alias("a"),
        F.sum(F.expr("power(1 - w / _tw, 2) / nullif(n - 1, 0)")).alias("b"),
    )
    return sums.selectExpr(
        *by, "(a / nullif(k - 1, 0)) / (1 + 2 * (k - 2) / nullif(k * k - 1, 0) * b) AS welch_statistic",
        "(k * k - 1) / nullif(3 * b, 0) AS welch_dof",
    )


def brown_forsythe_moments(rows: DataFrame, by: list[str]) -> DataFrame:
    medians = grouped_quantiles(rows, "x", {"_med": 0.5}, [*by, "g"])
    spread = join_groups(rows, cut_lineage(medians), [*by, "g"]).withColumn("x", F.abs(F.col("x") - F.col("_med")))
    return group_moments(spread, by).where("n > 1")


def check_equal_variance(df, column, group_by, by=()) -> DataFrame:
    """Median-centred Levene test; ``passed`` is null where it cannot be judged."""
    by = list(by)
    rows = labelled(df, group_by, column, by)
    f = one_way(brown_forsythe_moments(rows, by), by)
    f = f.withColumn("p_value", dist.f_sf(F.col("statistic"), F.col("dof_between"), F.col("dof_within")))
    return f.select(
        *by, "statistic", "dof_between", "dof_within", "p_value",
        F.when(F.col("k") > 1, F.col("p_value") >= ALPHA).alias("passed"))


def _attach(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Put one-row-per-segment results side by side (a single row each without segments)."""
    if by:
        return a.join(b, by)
    key = F.lit(0).alias("_k")
    return a.select("*", key).join(F.broadcast(b.select("*", key)), "_k").drop("_k")


def welch_anova(df, column, group_by, by=()) -> DataFrame:
    by = list(by)
    moments = group_moments(labelled(df, group_by, column, by), by)
    both = _attach(one_way(moments, by), welch(moments, by), by)
    return both.select(
        *by, "k", "n", F.col("welch_statistic").alias("statistic"), "dof_between",
        F.col("welch_dof").alias("dof_within"),
        dist.f_sf(F.col("welch_statistic"), F.col("dof_between"), F.col("welch_dof")).alias("p_value"))


def anova(df, column, group_by, by=()) -> DataFrame:
    """Omnibus test: the classic F, or Welch's when the spreads differ."""
    by = list(by)
    rows = labelled(df, group_by, column, by)
    moments = group_moments(rows, by)
    classic = one_way(moments, by)
    classic = classic.withColumn("statistic", refuse(
        F.col("k") < 2, "anova: needs at least two groups", by, F.col("statistic")))
    classic = classic.withColumn("statistic", refuse(
        F.col("smallest_group") < 2, "anova: every group needs two values", by, F.col("statistic")))
    levene = check_equal_variance(df, column, group_by, by).select(
        *by, F.col("p_value").alias("levene_p"), F.col("passed").alias("equal_variance"))
    all_rows = _attach(_attach(classic, welch(moments, by), by), levene, by)
    unequal = F.coalesce(~F.col("equal_variance"), F.lit(False))
    picked = all_rows.select(
        *by, "k", "n", F.when(unequal, "welch").otherwise("classic").alias("test"),
        F.when(unequal, F.col("welch_statistic")).otherwise(F.col("statistic")).alias("statistic"),
        "dof_between",
        F.when(unequal, F.col("welch_dof")).otherwise(F.col("dof_within")).alias("dof_within"),
        "ss_between", "ss_within", "eta_squared", "omega_squared", "levene_p", "equal_variance",
    )
    return picked.withColumn(
        "p_value", dist.f_sf(F.col("statistic"), F.col("dof_between"), F.col("dof_within")))


def tukey_hsd(df, column, group_by, by=(), max_groups: int | None = None) -> DataFrame:
    """All pairwise group differences with studentized-range p-values and intervals.

    The pairs are pairs of group summaries, and are the result itself; ``max_groups`` refuses more groups.
    """
    by = list(by)
    moments = group_moments(labelled(df, group_by, column, by), by).where("n > 1")
    pooled = one_way(moments, by).select(
        *by, refuse(F.lit(max_groups is not None) & (F.col("k") > F.lit(max_groups)), f"tukey: more than {max_groups} groups", by,
                    F.col("k").cast("double")).alias("k"),
        "dof_within", F.expr("ss_within / dof_within").alias("msw"))
    listed = _attach(
        moments.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("g", "n", "mean"))).alias("gs")),
        pooled, by)
    pairs = listed.select("*", F.posexplode("gs").alias("i", "a")).select(
        "*", F.explode(F.expr("slice(gs, i + 2, size(gs))")).alias("b"))
    pairs = pairs.selectExpr(
        *by, "a.g AS group1", "b.g AS group2", "a.mean - b.mean AS difference", "k", "dof_within",
        "sqrt(msw / 2 * (1 / a.n + 1 / b.n)) AS se")
    width = dist.tukey_ppf(F.lit(0.95), F.col("k"), F.col("dof_within")) * F.col("se")
    return pairs.select(
        *by, "group1", "group2", "difference",
        F.expr("abs(difference) / se").alias("q"),
        dist.tukey_sf(F.abs(F.col("difference")) / F.col("se"), F.col("k"), F.col("dof_within")).alias("p_value"),
        (F.col("difference") - width).alias("ci95_low"), (F.col("difference") + width).alias("ci95_high"))


def check_group_sizes(df, column, group_by, minimum=5, by=()) -> DataFrame:
    sizes = labelled(df, group_by, column, by).groupBy(*by, "g").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(
        F.min_by("g", F.struct("n", "g")).alias("smallest_group"), F.min("n").alias("n")
    ).withColumn("passed", F.col("n") >= minimum)


def check_paired_completeness(df, column, column2, by=()) -> DataFrame:
    """Pairs used, dropped for a missing side, and tied; null verdict when any were lost."""
    pairs = complete_pairs(df, column, column2, by)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    counts = pairs.groupBy(*by).agg(
        F.count_if(both & (F.col("a") != F.col("b"))).alias("n_pairs"),
        F.count_if(~both).alias("n_dropped"),
        F.count_if(both & (F.col("a") == F.col("b"))).alias("n_tied"))
    return counts.withColumn("passed", F.expr("CASE WHEN n_dropped + n_tied = 0 THEN TRUE END"))


# --------------------------------------------------------------------------- normality


def moments_expr(x: Column) -> list[Column]:
    return [
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
    ]


CORRECTED_SKEW = "CASE WHEN n > 2 THEN g1 * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) END"
CORRECTED_KURTOSIS = (
    "CASE WHEN n > 3 THEN (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3)) * ((n + 1) * g2 + 6) END"
)


def dagostino(stats: DataFrame) -> DataFrame:
    """K² from the population skewness and kurtosis (columns n, g1, g2), closed form."""
    steps = {
        "m": "CAST(n AS DOUBLE)",
        "y": "g1 * sqrt((m + 1) * (m + 3) / (6 * (m - 2)))",
        "beta": "3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9))",
        "w2": "-1 + sqrt(2 * (beta - 1))",
        "ya": "y / sqrt(2 / (w2 - 1))",
        "z1": "ln(ya + sqrt(ya * ya + 1)) / sqrt(0.5 * ln(w2))",
        "x": "(g2 + 3 - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) / "
             "((m + 1) * (m + 1) * (m + 3) * (m + 5)))",
        "rb": "6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * "
              "sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3)))",
        "a": "6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb)))",
        "den": "1 + x * sqrt(2 / (a - 4))",
        "z2": "((1 - 2 / (9 * a)) - sign(den) * power((1 - 2 / a) / abs(den), 1.0D / 3)) / sqrt(2 / (9 * a))",
    }
    out = stats.where("n >= 20 AND g1 IS NOT NULL")
    for name, expr in steps.items():
        out = out.withColumn(name, F.expr(expr))
    return out.withColumn("k2", F.expr("z1 * z1 + z2 * z2"))


SHAPIRO_MAX = 5000


def shapiro(values):
    """Royston's W and p for one sample of 3 to 5000 values."""
    import math

    import numpy as np

    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    m = np.array([norm_point((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    a, u = np.zeros(n), 1.0 / math.sqrt(n)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    else:
        # fixed values: Royston's polynomial coefficients
        a[-1] = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
        if n > 5:
            a[-2] = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1] = -a[-2]
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[0] = -a[-1]
    centred = x - x.mean()
    w = min(1.0, float(a @ centred) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, p)
    if w >= 1.0:
        return w, 1.0
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log(1 - w) >= gamma:
            return w, 0.0
        y = -math.log(gamma - math.log(1 - w))
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y = math.log(1 - w)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], math.log(n))
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], math.log(n)))
    return w, norm_upper((y - mu) / sigma)


def normality_test(df, column, group_by=None, robust_n: int = 30) -> DataFrame:
    """Moments and a normality p per group (or overall): Shapiro-Wilk up to 5 000 values,
    D'Agostino K² beyond. Only groups small enough for Shapiro travel to a Python task."""
    if group_by is None:
        rows = df.select(F.lit("(all rows)").alias("g"), number(quoted(column)).alias("x")).dropna()
    else:
        rows = labelled(df, group_by, column)
    stats = rows.groupBy("g").agg(*moments_expr(F.col("x"))).where("n >= 3")
    small = stats.where(f"n <= {SHAPIRO_MAX} AND sd > 0").select("g")

    def per_group(key, pdf):
        import pandas as pd

        w, p = shapiro(pdf["x"])
        return pd.DataFrame({"g": [key[0]], "statistic": [w], "p_value": [p]})

    shapiro_rows = rows.join(small, "g").groupBy("g").applyInPandas(
        per_group, "g string, statistic double, p_value double")
    large = dagostino(stats.where(f"n > {SHAPIRO_MAX}")).select(
        "g", F.col("k2").alias("statistic"), dist.chi2_sf(F.col("k2"), F.lit(2.0)).alias("p_value"))
    out = stats.join(shapiro_rows.unionByName(large), "g", "left").selectExpr(
        "g", "n", "mean", "sd", f"{CORRECTED_SKEW} AS skewness", f"{CORRECTED_KURTOSIS} AS kurtosis",
        f"CASE WHEN n <= {SHAPIRO_MAX} THEN 'shapiro' ELSE 'dagostino' END AS test",
        "statistic", "p_value", f"p_value >= {ALPHA} AS normal",
        f"CASE WHEN p_value < {ALPHA} THEN n >= {robust_n} END AS mean_robust")
    return out.withColumnRenamed("g", group_by or "group")


def check_normality(df, column, group_by=None) -> DataFrame:
    """Three-valued verdict; a failed test on 30 or more values still suits a test of means."""
    name = group_by or "group"
    return normality_test(df, column, group_by).select(
        name, "n", "p_value", F.col("normal").alias("passed"),
        F.expr("CASE WHEN normal IS NULL THEN 'not testable' WHEN normal THEN 'consistent with normality' "
               "WHEN mean_robust THEN 'departs from normality; means are robust at this size' "
               "ELSE 'departs from normality; consider a rank-based test' END").alias("verdict"))
