"""Model terms and the cross-product pass that every linear fit shares.

Data is touched only by aggregations of products of columns; a k-by-k matrix comes back to
the driver. Terms are centred and scaled first, so that the products stay well conditioned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.errors import Refusal, need_columns
from tallywork.functions.cells import dtype_of, is_date, is_number, number, quoted

INTERCEPT = "(Intercept)"
MAX_DUMMIES = 20


@dataclass
class Terms:
    """Encoded complete rows (y, t0..tk-1 standardized, extras) and how to undo the scaling."""

    rows: DataFrame
    names: list[str]
    means: np.ndarray
    sds: np.ndarray
    n: int
    n_excluded: int
    references: dict[str, str]

    @property
    def k(self) -> int:
        return len(self.names)

    @property
    def z(self) -> list[Column]:
        return [F.col(f"t{i}") for i in range(self.k)]

    def unscale(self) -> np.ndarray:
        """Matrix from standardized (intercept first) to original coefficients."""
        a = np.eye(self.k + 1)
        for j in range(self.k):
            a[j + 1, j + 1] = 1.0 / self.sds[j]
            a[0, j + 1] = -self.means[j] / self.sds[j]
        return a

    def linear(self, beta: np.ndarray) -> Column:
        out = F.lit(float(beta[0]))
        for b, z in zip(beta[1:], self.z):
            out = out + F.lit(float(b)) * z
        return out


def level_names(rows: DataFrame, column: str, name: str | None = None) -> list[str]:
    found = rows.select(quoted(column).cast("string").alias("v")).dropna().distinct().limit(MAX_DUMMIES + 2).collect()
    if len(found) > MAX_DUMMIES + 1:
        raise Refusal(f"regressor '{name or column}' has more than {MAX_DUMMIES + 1} levels; group the categories")
    return sorted(r["v"] for r in found)


def design_matrix(
    df: DataFrame, y: str | Column, x: list[str], extra: dict[str, Column] | None = None,
    carry: list[str] = (),
) -> Terms:
    """Listwise deletion, dummies against the alphabetically first level, and refusals for
    constant, collinear or too many terms.

    ``extra`` adds needed numeric columns (an exposure), ``carry`` plain ones (row order).
    """
    extra = extra or {}
    need_columns(df, [*x, *([y] if isinstance(y, str) else [])])
    if isinstance(y, str) and y in x:
        raise Refusal(f"the outcome '{y}' cannot also be a regressor")
    if len(set(x)) < len(x) or not x:
        raise Refusal("regressors must be given once each")
    for c in x:
        if is_date(dtype_of(df, c)):
            raise Refusal(f"regressor '{c}' is a date; derive a number from it first")
    outcome = number(quoted(y)) if isinstance(y, str) else y
    numeric = [c for c in x if is_number(dtype_of(df, c))]
    base = df.select(
        outcome.alias("y"), *[e.alias(n) for n, e in extra.items()], *[quoted(c) for c in carry],
        *[(number(quoted(c)) if c in numeric else quoted(c).cast("string")).alias(f"x_{i}")
          for i, c in enumerate(x)])
    rows = base.dropna(subset=["y", *extra, *[f"x_{i}" for i in range(len(x))]])
    names, cols, references = [], [], {}
    for i, c in enumerate(x):
        if c in numeric:
            names.append(c)
            cols.append(F.col(f"x_{i}"))
            continue
        levels = level_names(rows, f"x_{i}", c)
        if len(levels) < 2:
            raise Refusal(f"regressor '{c}' has a single value, so it carries no information")
        references[c] = levels[0]
        for level in levels[1:]:
            names.append(f"{c}[{level}]")
            cols.append((F.col(f"x_{i}") == F.lit(level)).cast("double"))
    s = rows.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{j}") for j, c in enumerate(cols)],
        *[F.stddev_samp(c).alias(f"s{j}") for j, c in enumerate(cols)]).first()
    n, k = s["n"], len(names)
    if n <= k + 1:
        raise Refusal(f"{n} usable row(s) for {k + 1} model parameters")
    means = np.array([s[f"m{j}"] for j in range(k)])
    sds = np.array([s[f"s{j}"] for j in range(k)])
    for j in range(k):
        if not sds[j] > 1e-12 * max(1.0, abs(means[j])):
            raise Refusal(f"regressor '{names[j]}' is constant, so it carries no information")
    z = [((c - F.lit(float(means[j]))) / F.lit(float(sds[j]))).alias(f"t{j}") for j, c in enumerate(cols)]
    return Terms(
        rows.select("y", *extra, *[quoted(c) for c in carry], *z), names, means, sds, n,
        df.count() - n, references)


def cross_products(terms: Terms, weight: Column | None = None, target: Column | None = None):
    """XᵀWX and XᵀWv with the intercept first, from one aggregation."""
    w = F.lit(1.0) if weight is None else F.col("_w")
    v = F.col("y") if target is None else F.col("_v")
    rows = terms.rows
    if weight is not None:
        rows = rows.withColumn("_w", weight)
    if target is not None:
        rows = rows.withColumn("_v", target)
    x = [F.lit(1.0), *terms.z]
    aggs = {}
    for i in range(len(x)):
        for j in range(i, len(x)):
            aggs[f"g{i}_{j}"] = F.sum(w * x[i] * x[j])
        aggs[f"v{i}"] = F.sum(w * x[i] * v)
    got = rows.agg(*[e.alias(n) for n, e in aggs.items()]).first()
    size = len(x)
    gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
    return gram, np.array([got[f"v{i}"] for i in range(size)])


def check_rank(gram: np.ndarray, names: list[str]) -> None:
    d = np.sqrt(np.diag(gram))
    if np.linalg.eigvalsh(gram / np.outer(d, d))[0] < 1e-10:
        raise Refusal(f"the regressors {names} are collinear: one is a combination of the others")


def variance_inflation(gram: np.ndarray) -> np.ndarray:
    """From the centred part of the Gram matrix; the intercept is left out."""
    inner = gram[1:, 1:]
    d = np.sqrt(np.diag(inner))
    return np.diag(np.linalg.inv(inner / np.outer(d, d)))
