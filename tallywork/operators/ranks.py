"""Rank tests on distributed average ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallywork.errors import Refusal
from tallywork.functions import dist
from tallywork.operators.means import (
    _attach, check_alternative, complete_pairs, labelled, refuse,
)
from tallywork.operators.ordering import (
    average_ranks, exact_quantiles, grouped_quantiles, range_bounds, with_range,
)
from tallywork.session import cut_lineage


def group_ranks(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per (by, value, group): how many rows, and their average rank in the segment."""
    counts = rows.groupBy(*by, "x", "g").agg(F.count("*").alias("n"))
    ranks = average_ranks(rows, "x", by).withColumnRenamed("n", "n_value")
    return counts.join(ranks, [*by, "x"])


def rank_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    return group_ranks(rows, by).groupBy(*by, "g").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"))


def tie_term(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    held = rows.groupBy(*by, value).agg(F.count("*").cast("double").alias("t"))
    return held.groupBy(*by).agg(F.sum(F.expr("t * t * t - t")).alias("ties"))


def rank_summary(df, column, group_by, by=()) -> DataFrame:
    """n, median, quartiles and mean rank per group."""
    by = list(by)
    rows = labelled(df, group_by, column, by)
    sums = rank_sums(rows, by)
    quarts = grouped_quantiles(rows, "x", {"median": 0.5, "q1": 0.25, "q3": 0.75}, [*by, "g"])
    out = sums.join(quarts, [*by, "g"]).selectExpr(
        *by, "g", "n", "median", "q1", "q3", "rank_sum / n AS mean_rank")
    return out.withColumnRenamed("g", group_by)


def kruskal(df, column, group_by, by=()) -> DataFrame:
    """Tie-corrected H with the rank-based eta squared."""
    by = list(by)
    rows = labelled(df, group_by, column, by)
    sums = rank_sums(rows, by).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("smallest"),
        F.sum(F.expr("rank_sum * rank_sum / n")).alias("s"))
    both = _attach(sums, tie_term(rows, "x", by), by).withColumn("m", F.col("n").cast("double"))
    h = F.expr("(12 / (m * (m + 1)) * s - 3 * (m + 1)) / nullif(1 - ties / (m * m * m - m), 0)")
    both = both.withColumn("statistic", refuse(F.col("k") < 2, "kruskal: needs at least two groups", by, h))
    both = both.withColumn("statistic", refuse(
        F.col("smallest") < 2, "kruskal: every group needs two values", by, F.col("statistic")))
    return both.select(
        *by, "k", "n", "statistic", (F.col("k") - 1).alias("dof"),
        dist.chi2_sf(F.col("statistic"), F.col("k") - 1).alias("p_value"),
        F.expr("(statistic - k + 1) / (n - k)").alias("eta_squared_rank"))


def mannwhitney(df, column, group_by, alternative="two-sided", by=()) -> DataFrame:
    """U of the first label: exact for small untied samples, else normal with ties and
    continuity correction; rank-biserial effect and difference of medians."""
    check_alternative(alternative)
    by = list(by)
    rows = labelled(df, group_by, column, by)
    medians = grouped_quantiles(rows, "x", {"median": 0.5}, [*by, "g"])
    g = rank_sums(rows, by).join(medians, [*by, "g"])
    row = g.groupBy(*by).agg(
        F.count("*").alias("k"), F.min("g").alias("group1"), F.max("g").alias("group2"),
        *[f(c, "g").alias(f"{c}{i}") for i, f in ((1, F.min_by), (2, F.max_by))
          for c in ("n", "rank_sum", "median")])
    row = _attach(row, tie_term(rows, "x", by), by)
    u = F.expr("rank_sum1 - n1 * (n1 + 1) / 2")
    row = row.withColumn("statistic", refuse(
        F.col("k") != 2, "mannwhitney: needs exactly two groups", by, u))
    row = row.withColumn("statistic", refuse(
        F.expr("least(n1, n2) < 2"), "mannwhitney: every group needs two values", by, F.col("statistic")))
    row = row.selectExpr("*", "CAST(n1 AS DOUBLE) * n2 AS pairs", "CAST(n1 + n2 AS DOUBLE) AS m")
    row = row.withColumn("sd", F.expr("sqrt(pairs / 12 * (m + 1 - ties / (m * (m - 1))))"))
    exact = F.expr("least(n1, n2) <= 8 AND ties = 0")
    toward = {
        "two-sided": "greatest(statistic, pairs - statistic)", "greater": "statistic",
        "less": "pairs - statistic"}[alternative]
    row = row.withColumn("_u", F.expr(toward))
    z = F.expr("(_u - pairs / 2 - 0.5) / nullif(sd, 0)")
    factor = 2.0 if alternative == "two-sided" else 1.0
    none = F.lit(None).cast("double")
    p = F.when(
        exact, dist.mann_whitney_exact(F.when(exact, F.col("_u")).otherwise(none), F.col("n1"), F.col("n2"))
    ).otherwise(dist.norm_sf(z))
    return row.select(
        *by, "group1", "group2", "n1", "n2", "statistic",
        F.least(F.lit(1.0), factor * p).alias("p_value"),
        F.when(exact, "exact").otherwise("asymptotic").alias("method"),
        F.expr("2 * statistic / pairs - 1").alias("rank_biserial"),
        F.expr("median1 - median2").alias("median_difference"))


# Distinct values of one side that a task holds; thresholds tried in one pass.
SIDE_ROWS, STEPS = 50_000, 64


def first_at_most(x: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """For each x the first place in the rising ``b`` from which on x - b <= t, as the machine subtracts."""
    at = np.searchsorted(b, x - t, side="left")
    while True:
        back = (at > 0) & (x - b[np.maximum(at - 1, 0)] <= t)
        on = (at < b.size) & (x - b[np.minimum(at, b.size - 1)] > t)
        if not back.any() and not on.any():
            return at
        at = at - back + (on & ~back)


def _block_counts(steps: list[float]):
    """Pairs of one block at or below each threshold, and the nearest differences to either side of it."""

    def run(left, right):
        import decimal

        import pandas as pd

        left, right = left.sort_values("x"), right.sort_values("y")
        x, w = left["x"].to_numpy(), left["w"].to_numpy(np.int64)
        b = right["y"].to_numpy()
        after = np.append(np.cumsum(right["v"].to_numpy(np.int64)[::-1])[::-1], 0)
        rows = []
        for i, t in enumerate(steps):
            at = first_at_most(x, b, t)
            n = after[at]
            total = (int((w * (n >> 20)).sum()) << 20) + int((w * (n & 0xFFFFF)).sum())  # products pass 64 bits
            le = np.where(at < b.size, x - b[np.minimum(at, b.size - 1)], -np.inf).max(initial=-np.inf)
            gt = np.where(at > 0, x - b[np.maximum(at - 1, 0)], np.inf).min(initial=np.inf)
            rows.append((i, decimal.Decimal(total), float(le), float(gt)))
        return pd.DataFrame(rows, columns=["i", "n", "le", "gt"])

    return run


class Differences:
    """All differences of two samples, never built: how many lie at or below a threshold.

    Each side is one row per distinct value, cut into ranges of bounded rows. Of two ranges either all differences
    lie to one side of a threshold, which their ends tell, or the pair of ranges is a block for one task. For
    thresholds close together the blocks follow a staircase: their number grows with the ranges, not their square.
    One row per range goes through the driver.
    """

    def __init__(self, first: DataFrame, second: DataFrame, distinct: tuple[int, int]):
        self.spark, self.sides, self.spans = first.sparkSession, [], []
        for side, n in zip((first, second), distinct):
            ranges = -(-n // SIDE_ROWS)
            cut = cut_lineage(with_range(side, "x", range_bounds(side, "x", ranges)) if ranges > 1 else side.withColumn("_b", F.lit(0)))
            spans = cut.groupBy("_b").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("w").alias("w")).orderBy("_b").collect()
            self.sides.append(cut)
            self.spans.append([np.array([r[c] for r in spans]) for c in ("_b", "lo", "hi")] + [[int(r["w"]) for r in spans]])
        self.after = [0]
        for w in reversed(self.spans[1][3]):
            self.after.append(self.after[-1] + w)
        self.after.reverse()

    def stairs(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """For each range of the first side: its blocks are the second side's ranges from .. up to the second number."""
        (_, a_lo, a_hi, _), (_, b_lo, b_hi, _) = self.spans
        return first_at_most(a_lo, b_hi, t), first_at_most(a_hi, b_lo, t)

    def between(self, t: float) -> tuple[int, int]:
        """Bounds of the number of differences at or below ``t``, from the ranges' ends alone."""
        some, every = self.stairs(t)
        weights = self.spans[0][3]
        return tuple(sum(w * self.after[j] for w, j in zip(weights, ends.tolist())) for ends in (every, some))

    def counts(self, steps: list[float]):
        """Per threshold: differences at or below it, the largest of them, and the smallest above it."""
        (a_no, a_lo, a_hi, weights), (b_no, b_lo, b_hi, _) = self.spans
        some, every = self.stairs(max(steps))[0], self.stairs(min(steps))[1]
        full = sum(w * self.after[j] for w, j in zip(weights, every.tolist()))
        le = max((a_hi[i] - b_lo[j] for i, j in enumerate(every) if j < len(b_lo)), default=-np.inf)
        gt = min((a_lo[i] - b_hi[j - 1] for i, j in enumerate(some) if j > 0), default=np.inf)
        blocks = [(int(a_no[i]), int(b_no[j])) for i in range(len(a_no)) for j in range(some[i], every[i])]
        got = {}
        if blocks:
            pairs = self.spark.createDataFrame(blocks, "_p int, _q int")
            left, right = (
                side.join(pairs, F.col("_b") == F.col(own)).select("_p", "_q", "x", "w") for side, own in zip(self.sides, ("_p", "_q")))
            right = right.toDF("_p2", "_q2", "y", "v")  # both sides come from one frame
            parts = left.groupBy("_p", "_q").cogroup(right.groupBy("_p2", "_q2")).applyInPandas(
                _block_counts(steps), "i int, n decimal(38,0), le double, gt double")
            rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.max("le").alias("le"), F.min("gt").alias("gt")).collect()
            got = {r["i"]: (int(r["n"]), r["le"], r["gt"]) for r in rows}
        none = (0, -np.inf, np.inf)
        return [(t, full + got.get(i, none)[0], max(le, got.get(i, none)[1]), min(gt, got.get(i, none)[2])) for i, t in enumerate(steps)]

    def nth(self, k: int) -> float:
        """The k-th smallest difference, k from 1."""
        lo = float(self.spans[0][1].min() - self.spans[1][2].max()) - 1.0
        hi = float(self.spans[0][2].max() - self.spans[1][1].min())
        ends = []
        for side in (1, 0):  # how far the ranges' ends alone lead: up to lo fewer than k, up to hi at least k
            low, high = lo, hi
            for _ in range(60):
                t = low + (high - low) / 2
                low, high = (t, high) if self.between(t)[side] < k else (low, t)
            ends.append(low if side else high)
        lo, hi = ends
        while True:
            steps = [float(t) for t in np.unique(np.append(np.linspace(lo, hi, STEPS + 2)[1:-1], [lo, hi]))]
            got = self.counts(steps)
            below, above = [r for r in got if r[1] < k], [r for r in got if r[1] >= k]
            if below and above and below[-1][3] >= above[0][2]:
                return above[0][2]
            new = below[-1][0] if below else lo, above[0][0] if above else hi
            if new == (lo, hi):
                return above[0][2] if above else below[-1][3]
            lo, hi = new


def hodges_lehmann(df, column, group_by) -> DataFrame:
    """Median of all pairwise differences (first label minus second), however many pairs there are.

    The differences are an implicit sorted matrix: each pass counts those at or below a ladder of thresholds
    (``Differences``) until two neighbours remain around the wanted rank.
    """
    spark = df.sparkSession
    held = cut_lineage(labelled(df, group_by, column).groupBy("g", "x").agg(F.count("*").alias("w")))
    sizes = {r["g"]: r for r in held.groupBy("g").agg(F.sum("w").alias("n"), F.count("*").alias("k")).limit(3).collect()}
    if len(sizes) != 2:
        raise Refusal("hodges_lehmann: needs exactly two groups")
    labels = sorted(sizes)
    sides = [held.where(F.col("g") == label).select("x", "w") for label in labels]
    both = Differences(*sides, tuple(sizes[label]["k"] for label in labels))
    n1, n2 = (sizes[label]["n"] for label in labels)
    lower = upper = both.nth((n1 * n2 + 1) // 2)
    if n1 * n2 % 2 == 0:
        _, n, _, above = both.counts([lower])[0]
        upper = lower if n > n1 * n2 // 2 else above
    return spark.createDataFrame([(n1, n2, float((lower + upper) / 2))], "n1 long, n2 long, shift double")


def wilcoxon(df, column, column2, alternative="two-sided", by=()) -> DataFrame:
    """Signed ranks of the non-zero differences; exact up to 50 untied pairs without zeros."""
    check_alternative(alternative)
    by = list(by)
    pairs = complete_pairs(df, column, column2, by).dropna(subset=["a", "b"]).withColumn(
        "d", F.expr("a - b"))
    counts = pairs.groupBy(*by).agg(
        F.count("*").alias("n_complete"), F.count_if(F.col("d") == 0).alias("n_tied"))
    signed = pairs.where("d <> 0").select(
        *by, F.abs("d").alias("x"), F.when(F.col("d") > 0, "+").otherwise("-").alias("g"))
    sums = group_ranks(signed, by).groupBy(*by).agg(
        F.sum("n").alias("n_pairs"),
        F.sum(F.expr("CASE WHEN g = '+' THEN n * rank ELSE 0 END")).alias("w_plus"),
        F.sum(F.expr("CASE WHEN g = '-' THEN n * rank ELSE 0 END")).alias("w_minus"))
    row = _attach(_attach(counts, sums, by), tie_term(signed, "x", by), by)
    row = row.withColumn("w_plus", refuse(
        F.col("n_pairs").isNull() | (F.col("n_pairs") == 0),
        "wilcoxon: every pair is identical, so there is nothing to test", by, F.col("w_plus")))
    row = row.withColumn("m", F.col("n_pairs").cast("double"))
    row = row.withColumn("_mean", F.expr("m * (m + 1) / 4")).withColumn(
        "_sd", F.expr("sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)"))
    exact = F.expr("n_pairs <= 50 AND ties = 0 AND n_tied = 0")
    toward = {"two-sided": "greatest(w_plus, w_minus)", "greater": "w_plus", "less": "w_minus"}[alternative]
    z = F.expr(f"({toward} - _mean) / nullif(_sd, 0)")
    none = F.lit(None).cast("double")
    p = F.when(
        exact, dist.wilcoxon_exact(F.when(exact, F.expr(toward)).otherwise(none), F.col("n_pairs"))
    ).otherwise(dist.norm_sf(z))
    factor = 2.0 if alternative == "two-sided" else 1.0
    stat = "least(w_plus, w_minus)" if alternative == "two-sided" else "w_plus"
    medians = exact_quantiles(pairs, {"d": F.col("d")}, [0.5])["d"][0] if not by else None
    out = row.select(
        *by, F.expr(stat).alias("statistic"), "w_plus", "w_minus", "n_pairs", "n_complete", "n_tied",
        F.least(F.lit(1.0), factor * p).alias("p_value"),
        F.when(exact, "exact").otherwise("asymptotic").alias("method"),
        F.expr("(w_plus - w_minus) / (w_plus + w_minus)").alias("rank_biserial"))
    if by:
        return out.join(grouped_quantiles(pairs, "d", {"median_difference": 0.5}, by), by)
    return out.withColumn("median_difference", F.lit(medians))
