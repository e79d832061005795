"""Which values count as extreme: the cleaning policy and the wider detection fences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallywork.errors import Refusal
from tallywork.functions import fixed
from tallywork.functions.cells import number, quoted, undecorated
from tallywork.operators.ordering import counted_quantiles, exact_quantiles


@dataclass(frozen=True)
class Policy:
    """``mad``: modified z-score above the threshold; ``iqr``: reach beyond the quartiles;
    ``none``: leave values alone."""

    method: str = "mad"
    threshold: float = fixed.MAD_THRESHOLD

    def __post_init__(self):
        if self.method not in ("mad", "iqr", "none"):
            raise Refusal(f"Unknown outlier method: {self.method}")

    def cutoff(self, threshold: float | None) -> float:
        return self.threshold if threshold is None else float(threshold)

    def row_reach(self, threshold: float | None) -> float:
        if threshold is not None:
            return float(threshold)
        return self.threshold if self.method == "iqr" else fixed.IQR_REACH

    def describe(self, threshold: float | None = None) -> str:
        cut = self.cutoff(threshold)
        return f"outside {cut:g}× IQR" if self.method == "iqr" else f"MAD z-score > {cut:g}"


def extreme_test(df: DataFrame, column: str, policy: Policy, threshold: float | None = None):
    """A test ``Column -> boolean Column`` with its cutoffs as literals, or None.

    None means the policy judges nothing here: it is off, or the column has too few values
    or too little spread.
    """
    x = number(quoted(column))
    if policy.method == "none":
        return None
    cut = policy.cutoff(threshold)

    def outside(lo, hi):
        return lambda c: F.coalesce((number(c) < F.lit(lo)) | (number(c) > F.lit(hi)), F.lit(False))

    if policy.method == "iqr":
        quarts, counts = counted_quantiles(df, {"x": x}, [0.25, 0.75])
        q1, q3 = quarts["x"]
        if counts["x"] < fixed.MIN_CLEANING_VALUES or q3 - q1 <= 0:
            return None
        return outside(q1 - cut * (q3 - q1), q3 + cut * (q3 - q1))
    medians, counts = counted_quantiles(df, {"x": x}, [0.5])
    if counts["x"] < fixed.MIN_CLEANING_VALUES:
        return None
    median = medians["x"][0]
    mad = exact_quantiles(df, {"d": F.abs(x - F.lit(median))}, [0.5])["d"][0]
    if mad == 0:
        return outside(*exact_quantiles(df, {"x": x}, [0.01, 0.99])["x"])
    score = lambda c: F.lit(fixed.MAD_SCALE) * F.abs(number(c) - F.lit(median)) / F.lit(mad)
    return lambda c: F.coalesce(score(c) > F.lit(cut), F.lit(False))


def outlier_mask(df, column, policy=Policy(), threshold=None, out="is_outlier") -> DataFrame:
    test = extreme_test(df, column, policy, threshold)
    return df.withColumn(out, test(quoted(column)) if test else F.lit(False))


def detection_fences(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple | None]:
    """Far cutoffs used to surface values, per named expression; None when meaningless."""
    quarts, counts = counted_quantiles(df, columns, [0.25, 0.75])
    flat = [n for n in columns if counts[n] >= fixed.MIN_DETECTION_VALUES and quarts[n][0] == quarts[n][1]]
    spread = df.agg(*[
        f(columns[n]).alias(f"{k}{i}") for i, n in enumerate(flat) for k, f in (("m", F.avg), ("s", F.stddev_samp))
    ]).first() if flat else None
    fences = {}
    for n in columns:
        fences[n] = None
        if counts[n] < fixed.MIN_DETECTION_VALUES:
            continue
        q1, q3 = quarts[n]
        if q3 > q1:
            reach = fixed.DETECT_IQR_REACH * (q3 - q1)
            fences[n] = (q1 - reach, q3 + reach)
        elif (spread[f"s{flat.index(n)}"] or 0) > 0:
            mean, reach = spread[f"m{flat.index(n)}"], fixed.DETECT_STD_REACH * spread[f"s{flat.index(n)}"]
            fences[n] = (mean - reach, mean + reach)
    return fences


def flag_outlier_cells(df: DataFrame, column: str, fences, out: str = "is_outlier") -> DataFrame:
    """Cells beyond recorded fences, after dropping currency signs, units and the like."""
    if not fences:
        return df.withColumn(out, F.lit(False))
    x = undecorated(quoted(column))
    beyond = (x < F.lit(fences[0])) | (x > F.lit(fences[1]))
    return df.withColumn(out, F.coalesce(beyond, F.lit(False)))
