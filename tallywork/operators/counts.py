"""Tests on counts and proportions, and the adjustment for several tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import quoted
from tallywork.operators.means import check_alternative, refuse
from tallywork.operators.ordering import range_bounds, running_sums, with_range
from tallywork.session import cut_lineage


def cell_counts(df, row, column, by=()) -> DataFrame:
    """Non-empty cells with their margins and expected counts."""
    need_columns(df, [row, column, *by])
    cells = (
        df.select(*by, quoted(row).cast("string").alias("r"), quoted(column).cast("string").alias("c"))
        .dropna().groupBy(*by, "r", "c").agg(F.count("*").alias("observed"))
    )
    return cells.withColumns({
        "row_total": F.sum("observed").over(W.partitionBy(*by, "r")),
        "column_total": F.sum("observed").over(W.partitionBy(*by, "c")),
        "row_cells": F.count("*").over(W.partitionBy(*by, "r")),
        "column_cells": F.count("*").over(W.partitionBy(*by, "c")),
    })


def chi_square_independence(df, row, column, by=()) -> DataFrame:
    """χ² (Yates when 2×2), with Cramér's V from the uncorrected value.

    Empty cells need no rows: they add nothing to Σ O²/E, and the margins are enough for
    the 2×2 correction and for the smallest expected count.
    """
    by = list(by)
    sums = cell_counts(df, row, column, by).groupBy(*by).agg(
        F.sum("observed").cast("double").alias("n"),
        F.sum(F.expr("1D / row_cells")).alias("_r"), F.sum(F.expr("1D / column_cells")).alias("_c"),
        F.sum(F.expr("CAST(observed AS DOUBLE) * observed / (CAST(row_total AS DOUBLE) * column_total)")).alias("_s"),
        F.sum(F.expr("1D / row_total / row_cells")).alias("_ir"),
        F.sum(F.expr("1D / column_total / column_cells")).alias("_ic"),
        F.min("row_total").alias("_mr"), F.min("column_total").alias("_mc"),
        F.max_by(F.struct("observed", "row_total", "column_total"), F.col("observed")).alias("_cell"),
    )
    x = sums.selectExpr(
        *by, "CAST(n AS BIGINT) AS n", "CAST(round(_r) AS BIGINT) AS n_rows",
        "CAST(round(_c) AS BIGINT) AS n_columns", "n * (_s - 1) AS chi2_uncorrected",
        "n * _ir * _ic AS _ie",
        "abs(_cell.observed - CAST(_cell.row_total AS DOUBLE) * _cell.column_total / n) AS _gap",
        "CAST(_mr AS DOUBLE) * _mc / n AS min_expected")
    x = x.withColumn("dof", F.expr("(n_rows - 1) * (n_columns - 1)"))
    chi2 = F.when(F.col("dof") == 1, F.expr("power(_gap - least(0.5D, _gap), 2) * _ie")).otherwise(
        F.col("chi2_uncorrected"))
    x = x.withColumn("statistic", refuse(
        F.expr("n_rows < 2 OR n_columns < 2"), "chi_square: needs at least a 2x2 table", by, chi2))
    return x.select(
        *by, "n", "n_rows", "n_columns", "statistic", "dof",
        dist.chi2_sf(F.col("statistic"), F.col("dof")).alias("p_value"), "chi2_uncorrected",
        F.expr("sqrt(chi2_uncorrected / (n * (least(n_rows, n_columns) - 1)))").alias("cramers_v"),
        "min_expected", (F.col("min_expected") >= 5).alias("expected_ok"))


def expected_counts(df, row, column) -> DataFrame:
    """Observed and expected count of every cell, empty ones included."""
    cells = cell_counts(df, row, column)
    levels = cells.select("c", "column_total").distinct().limit(10_001).collect()
    if len(levels) > 10_000:
        raise Refusal(f"'{column}' has too many levels for a table of expected counts")
    total = sum(r["column_total"] for r in levels)
    columns = F.array(*[F.struct(F.lit(r["c"]).alias("c"), F.lit(r["column_total"]).alias("ct"))
                        for r in levels])
    every = cells.select("r", "row_total").distinct().select(
        "r", "row_total", F.explode(columns).alias("s")).select("r", "row_total", "s.*")
    return every.join(cells.select("r", "c", "observed"), ["r", "c"], "left").select(
        F.col("r").alias(row), F.col("c").alias(column),
        F.coalesce("observed", F.lit(0)).alias("observed"),
        (F.col("row_total").cast("double") * F.col("ct") / F.lit(float(total or 1))).alias("expected"))


def check_expected_counts(df, row, column) -> DataFrame:
    return expected_counts(df, row, column).agg(
        F.min("expected").alias("smallest"), F.count_if(F.col("expected") < 5).alias("n_below"),
        F.count("*").alias("n_cells")).withColumn("passed", F.col("n_below") == 0)


def fisher_exact(df, row, column, by=()) -> DataFrame:
    """2×2 table in label order: sample odds ratio ad/bc and the exact two-sided p."""
    by = list(by)
    cells = cell_counts(df, row, column, by)
    span = cells.withColumns({
        "r1": F.min("r").over(W.partitionBy(*by)), "c1": F.min("c").over(W.partitionBy(*by))})
    top, left = F.col("r") == F.col("r1"), F.col("c") == F.col("c1")
    at = lambda when: F.coalesce(F.sum(F.when(when, F.col("observed"))), F.lit(0))
    four = span.groupBy(*by).agg(
        F.count_distinct("r").alias("_nr"), F.count_distinct("c").alias("_nc"),
        F.min("r").alias("row1"), F.max("r").alias("row2"),
        F.min("c").alias("column1"), F.max("c").alias("column2"),
        at(top & left).alias("a"), at(top & ~left).alias("b"),
        at(~top & left).alias("c_"), at(~top & ~left).alias("d"))
    odds = refuse(F.expr("_nr <> 2 OR _nc <> 2"), "fisher_exact: needs a 2x2 table", by,
                  F.expr("CAST(a AS DOUBLE) * d / nullif(CAST(b AS DOUBLE) * c_, 0)"))
    return four.withColumn("odds_ratio", odds).select(
        *by, "row1", "row2", "column1", "column2", "a", "b", F.col("c_").alias("c"), "d", "odds_ratio",
        dist.fisher_p(F.col("a"), F.col("b"), F.col("c_"), F.col("d")).alias("p_value"))


def chi_square_goodness_of_fit(df, column, by=()) -> DataFrame:
    """Against equal counts in every category; Cohen's w."""
    by = list(by)
    need_columns(df, [column, *by])
    counts = df.where(quoted(column).isNotNull()).groupBy(*by, quoted(column).alias("v")).agg(
        F.count("*").cast("double").alias("o"))
    whole = W.partitionBy(*by)
    sums = counts.withColumn("e", F.avg("o").over(whole)).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("o").alias("n"), F.first("e").alias("expected"),
        F.sum(F.expr("power(o - e, 2) / e")).alias("x2"))
    sums = sums.withColumn("statistic", refuse(
        F.col("k") < 2, "chi_square: a goodness-of-fit test needs two categories", by, F.col("x2")))
    return sums.select(
        *by, F.col("n").cast("long").alias("n"), "statistic", (F.col("k") - 1).alias("dof"), "expected",
        dist.chi2_sf(F.col("statistic"), F.col("k") - 1).alias("p_value"),
        F.expr("sqrt(statistic / n)").alias("cohens_w"))


# ------------------------------------------------------------------------- proportions

Z95 = 1.959963984540054  # fixed value: 0.975 quantile of the standard normal


def wilson_ci(x: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = x / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def newcombe_ci(x1, n1, x2, n2) -> tuple[Column, Column]:
    """Difference of two proportions from their Wilson intervals."""
    p1, p2 = x1 / n1, x2 / n2
    l1, u1 = wilson_ci(x1, n1)
    l2, u2 = wilson_ci(x2, n2)
    low = p1 - p2 - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u2 - p2, 2))
    high = p1 - p2 + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p2 - l2, 2))
    return low, high


def cohens_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def _successes(df, column, success_value, extra) -> DataFrame:
    hit = (quoted(column).cast("string") == F.lit(str(success_value))).cast("long")
    return df.select(*extra, hit.alias("hit"))


def _must_occur(df, column, success_value) -> None:
    need_columns(df, [column])
    if df.where(quoted(column).cast("string") == F.lit(str(success_value))).isEmpty():
        raise Refusal(f"proportion_test: {success_value!r} does not occur in {column!r}")


def proportion_test(df, column, success_value, p0, alternative="two-sided", by=()) -> DataFrame:
    """One-sample z with a Wilson interval."""
    check_alternative(alternative)
    if not 0.0 < p0 < 1.0:
        raise Refusal(f"proportion_test: p0 must be between 0 and 1, got {p0}")
    _must_occur(df, column, success_value)
    rows = _successes(df, column, success_value, list(by)).dropna(subset=["hit"])
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("hit").alias("successes"))
    p = F.col("successes") / F.col("n")
    low, high = wilson_ci(F.col("successes"), F.col("n"))
    s = s.withColumn("statistic", (p - p0) / F.sqrt(F.lit(p0 * (1 - p0)) / F.col("n")))
    return s.select(
        *by, "n", "successes", p.alias("proportion"), "statistic",
        dist.z_p_value(F.col("statistic"), alternative).alias("p_value"),
        low.alias("ci95_low"), high.alias("ci95_high"), cohens_h(p, F.lit(p0)).alias("cohens_h"),
        (F.col("n") * min(p0, 1 - p0) >= 5).alias("expected_ok"))


def proportion_test_two(df, column, success_value, group_by, alternative="two-sided", by=()):
    """Pooled z of two groups (label order), Newcombe interval, Cohen's h."""
    check_alternative(alternative)
    by = list(by)
    need_columns(df, [group_by])
    _must_occur(df, column, success_value)
    rows = _successes(df, column, success_value, [*by, quoted(group_by).cast("string").alias("g")]).dropna()
    g = rows.groupBy(*by, "g").agg(F.count("*").alias("n"), F.sum("hit").alias("x"))
    row = g.groupBy(*by).agg(
        F.count("*").alias("k"), F.min("g").alias("group1"), F.max("g").alias("group2"),
        F.min_by("n", "g").alias("n1"), F.min_by("x", "g").alias("x1"),
        F.max_by("n", "g").alias("n2"), F.max_by("x", "g").alias("x2"))
    row = row.selectExpr("*", "x1 / n1 AS p1", "x2 / n2 AS p2", "(x1 + x2) / (n1 + n2) AS pooled")
    z = F.expr("(p1 - p2) / nullif(sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)), 0)")
    row = row.withColumn("statistic", refuse(
        F.col("k") != 2, "proportion_test: needs exactly two groups", by, z))
    low, high = newcombe_ci(*[F.col(c) for c in ("x1", "n1", "x2", "n2")])
    return row.select(
        *by, "group1", "group2", "n1", "n2", "p1", "p2", "statistic",
        dist.z_p_value(F.col("statistic"), alternative).alias("p_value"),
        F.expr("p1 - p2").alias("difference"), low.alias("ci95_low"), high.alias("ci95_high"),
        cohens_h(F.col("p1"), F.col("p2")).alias("cohens_h"),
        F.expr("least(n1, n2) * least(pooled, 1 - pooled) >= 5").alias("expected_ok"))


# ---------------------------------------------------------------------- several tests


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", by=()) -> DataFrame:
    """Step-up false-discovery adjustment of one family of tests; null p-values pass through.

    Works on equal p-values together and needs their counts only, so a family may hold
    every segment of a fleet job.
    """
    by = list(by)
    tests = cut_lineage(tests)  # the tests themselves run once
    known = tests.where(F.col(p).isNotNull())
    held = known.groupBy(*by, p).agg(F.count("*").alias("_n"))
    m = known.groupBy(*by).agg(F.count("*").alias("_m"))
    ranked = running_sums(held, p, {"_before": "_n"}, by)
    if by:
        ranked = ranked.join(m, by)
    else:
        ranked = ranked.withColumn("_m", F.lit(m.first()["_m"]))
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.col("_n")))
    adjusted = suffix_min(ranked, p, "_q", by)
    joined = tests.join(adjusted.select(*by, p, "_adj"), [*by, p], "left")
    return joined.select(*tests.columns, 
        F.when(F.col("_adj") > 1, 1.0).otherwise(F.col("_adj")).alias("p_adjusted"))


def suffix_min(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """Smallest ``value`` at or after each row in ``order``, range by range."""
    cut = with_range(df, order, range_bounds(df, order))
    later = W.partitionBy(*by).orderBy("_b").rowsBetween(1, W.unboundedFollowing)
    mins = cut.groupBy(*by, "_b").agg(F.min(value).alias("_min")).select(
        *by, "_b", F.min("_min").over(later).alias("_later"))
    here = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(0, W.unboundedFollowing)
    return cut.join(mins, [*by, "_b"]).withColumn(
        "_adj", F.least(F.min(value).over(here), F.col("_later"))).drop("_b", "_later")


def test_family(results: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """One row (label, test, p_value) per test of an answer, adjusted together.

    ``results`` maps a label to (test name, frame with a p_value column). Diagnostics and
    tests that already adjust themselves are left out by the caller.
    """
    parts = [
        df.select(F.lit(label).alias("label"), F.lit(name).alias("test"), "p_value")
        for label, (name, df) in results.items()
    ]
    family = parts[0]
    for part in parts[1:]:
        family = family.unionByName(part)
    return benjamini_hochberg(family).withColumn("significant", F.col("p_adjusted") < 0.05)


test_family.__test__ = False
