"""Pairs of columns: correlations, a fitted line, plotted points, group comparison."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, functions as F, Window as W

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import number, quoted
from tallywork.operators.means import (
    group_moments, group_summary, labelled, one_way, two_groups, mean_difference,
)
from tallywork.operators.ordering import average_ranks, range_bounds, with_range
from tallywork.session import cut_lineage


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric columns x0, x1, … of the rows that have all of them."""
    need_columns(df, columns)
    return df.select(*[number(quoted(c)).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()


def _pairs_from_corr(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All r in one aggregation, then one row per pair with its p-value."""
    pairs = list(itertools.combinations(range(len(columns)), 2))
    wide = rows.agg(
        F.count("*").alias("n"), *[F.corr(f"x{i}", f"x{j}").alias(f"r{i}_{j}") for i, j in pairs])
    long = wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(columns[i]).alias("column1"), F.lit(columns[j]).alias("column2"),
                 F.col(f"r{i}_{j}").alias("r")) for i, j in pairs])).alias("s")).select("n", "s.*")
    t = F.expr("r * sqrt((n - 2) / nullif(1 - r * r, 0))")
    few = F.when(F.col("n") < 3, F.raise_error(F.lit("correlation: needs three complete rows")).cast("double"))
    return long.select(
        "column1", "column2", "n", F.coalesce(few, F.col("r")).alias("r"),
        F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(dist.t_sf2(t, F.col("n") - 2)).alias("p_value"))


def ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Replace every column by average ranks: one pass of distinct values per column."""
    joined = rows
    for name in names:
        ranks = average_ranks(rows, name).select(name, F.col("rank").alias(f"_r_{name}"))
        joined = joined.join(ranks, name)
    return joined.select(*[F.col(f"_r_{n}").alias(n) for n in names])


def correlation_pairs(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    if len(columns) < 2:
        raise Refusal("correlation: needs at least two columns")
    rows = complete(df, columns)
    if method == "pearson":
        return _pairs_from_corr(rows, columns)
    if method == "spearman":
        return _pairs_from_corr(ranked(rows, rows.columns), columns)
    if method == "kendall":
        parts = [
            kendall(df.dropna(subset=columns), columns[i], columns[j])
            for i, j in itertools.combinations(range(len(columns)), 2)
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
    raise Refusal(f"Unknown correlation method: {method}")


def correlation_matrix(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """Square matrix, one row per column, rounded to four digits."""
    pairs = correlation_pairs(df, columns, method)
    both = pairs.select("column1", "column2", "r").unionByName(
        pairs.select(F.col("column2").alias("column1"), F.col("column1").alias("column2"), "r"))
    wide = both.groupBy("column1").pivot("column2", columns).agg(F.first("r"))
    return wide.select(
        F.col("column1").alias("column"),
        *[F.round(F.when(F.col("column1") == c, F.lit(1.0)).otherwise(quoted(c)), 4).alias(c)
          for c in columns])


# ----------------------------------------------------------------------------- kendall


def _falling_pairs(y_rank, w, cell):
    """Weighted pairs inside one cell where y falls along the given order.

    Walks the bits of the y rank from the top: a pair is counted at the highest bit that
    differs, among elements whose higher bits agree. The elements of one cell are adjacent.
    """
    total = 0.0
    for bit in range(int(y_rank.max()).bit_length() - 1, -1, -1):
        group = cell * (int(y_rank.max() >> (bit + 1)) + 1) + (y_rank >> (bit + 1))
        order = np.argsort(group, kind="stable")
        g, one, ws = group[order], (y_rank[order] >> bit) & 1, w[order]
        ones = np.cumsum(ws * one)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        lengths = np.diff(np.r_[starts, g.size])
        base = np.repeat(np.r_[0.0, ones][starts], lengths)
        total += float((ws * (1 - one) * (ones - base)).sum())
    return total


def _inversions(block, key):
    """Discordant weight of one block; pairs inside one ``key`` cell are left out if given."""
    block = block.sort_values(["x", "y"])
    y = np.unique(block["y"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    w = block["w"].to_numpy().astype(float)
    whole = _falling_pairs(y, w, np.zeros(len(y), dtype=np.int64)) if y.max() > 0 else 0.0
    if key is None or y.max() == 0:
        return whole
    cell = np.unique(block[key].to_numpy(), return_inverse=True)[1].astype(np.int64)
    return whole - _falling_pairs(y, w, cell)


# Distinct pairs of values in one range of x or of y.
BLOCK_ROWS = 50_000


def _across(cut: DataFrame) -> float:
    """Weighted pairs with a smaller x-range and a larger y-range.

    Two y-ranges differ first at one bit of their numbers. For each bit, cells are summed by the bits above it and
    their x-range: cells with the bit set that come before cells without it are such pairs. All bits are one
    aggregation; what a window sees are sums, one per x-range.
    """
    top = cut.agg(F.max("by")).first()[0] or 0
    if not top:
        return 0.0
    cells = cut.groupBy("bx", "by").agg(F.sum("w").cast("double").alias("w"))
    bits = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(top.bit_length() - 1))))
    above, one = F.expr("shiftright(by, bit + 1)"), F.expr("shiftright(by, bit) & 1")
    sums = bits.groupBy("bit", above.alias("above"), "bx").agg(F.sum(F.col("w") * one).alias("ones"), F.sum(F.col("w") * (1 - one)).alias("zeros"))
    before = F.sum("ones").over(W.partitionBy("bit", "above").orderBy("bx").rowsBetween(W.unboundedPreceding, -1))
    return sums.withColumn("before", before).agg(F.sum(F.col("zeros") * F.col("before"))).first()[0] or 0.0


def kendall(df: DataFrame, column: str, column2: str) -> DataFrame:
    """tau-b with ties; p is exact for untied rows up to 33, or with one discordant (or concordant) pair at most.

    Discordant pairs are counted in three exact parts: between ranges of x and of y (``_across``), inside one
    x-range, and inside one y-range across x-ranges. Ranges are as many as keep a block at BLOCK_ROWS distinct
    pairs. A value that fills a range by itself has no discordant pair inside that range.
    """
    rows = complete(df, [column, column2]).select(F.col("x0").alias("x"), F.col("x1").alias("y"))
    held = cut_lineage(rows.groupBy("x", "y").agg(F.count("*").alias("w")))
    ranges = max(2, -(-held.count() // BLOCK_ROWS))
    cut = cut_lineage(with_range(with_range(held, "x", range_bounds(held, "x", ranges), "bx"), "y", range_bounds(held, "y", ranges), "by"))
    across = _across(cut)

    def in_x(key, pdf):
        import pandas as pd

        return pd.DataFrame({"d": [float(_inversions(pdf, None))]})

    def in_y(key, pdf):
        import pandas as pd

        return pd.DataFrame({"d": [float(_inversions(pdf, "bx"))]})

    spans = lambda c, b: cut.groupBy(b).agg(F.min(c).alias("_a"), F.max(c).alias("_z")).where("_a < _z").select(b)
    mixed_x = cut.join(F.broadcast(spans("x", "bx")), "bx")  # one row per range
    mixed_y = cut.join(F.broadcast(spans("y", "by")), "by")
    same_x = mixed_x.groupBy("bx").applyInPandas(in_x, "d double").agg(F.sum("d")).first()[0] or 0.0
    # in a range of equal y no pair is discordant
    same_y = mixed_y.groupBy("by").applyInPandas(in_y, "d double").agg(F.sum("d")).first()[0] or 0.0
    discordant = across + same_x + same_y

    def ties(c):
        t = held.groupBy(c).agg(F.sum("w").cast("double").alias("t"))
        return t.agg(
            F.sum(F.expr("t * (t - 1) / 2")), F.sum(F.expr("t * (t - 1) * (t - 2)")),
            F.sum(F.expr("t * (t - 1) * (2 * t + 5)")), F.sum("t")).first()

    tx, x0, x1, n = ties("x")
    ty, y0, y1, _ = ties("y")
    if not n or n < 3:
        raise Refusal("correlation: needs three complete rows")
    both = held.agg(F.sum(F.expr("CAST(w AS DOUBLE) * (w - 1) / 2"))).first()[0]
    pairs = n * (n - 1) / 2
    concordant_minus = pairs - tx - ty + both - 2 * discordant
    tau = concordant_minus / np.sqrt(pairs - tx) / np.sqrt(pairs - ty) if min(pairs - tx, pairs - ty) > 0 else None
    m = n * (n - 1)
    var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / m + x0 * y0 / (9 * m * (n - 2))
    p = 2 * dist.norm_upper(abs(concordant_minus) / np.sqrt(var)) if var > 0 else None
    if tx == ty == 0 and (n <= 33 or min(discordant, pairs - discordant) <= 1):
        p = dist.discordance_p(int(n), int(round(discordant)))
    return df.sparkSession.createDataFrame(
        [(column, column2, int(n), None if tau is None else float(tau), None if p is None else float(p))],
        "column1 string, column2 string, n long, r double, p_value double")


# ----------------------------------------------------------------------------- scatter


def scatter_with_fit(
    df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None, max_groups: int | None = None
) -> DataFrame:
    """Least-squares line over all complete rows, overall and per colour group (refused above ``max_groups``, if given)."""
    names = [c for c in (x, y, size, color) if c]
    if len(set(names)) < len(names):
        raise Refusal("scatter: axes, size and color must be different columns")
    need_columns(df, names)
    rows = df.select(
        number(quoted(x)).alias("x"), number(quoted(y)).alias("y"),
        *([number(quoted(size)).alias("s")] if size else []),
        (F.coalesce(quoted(color).cast("string"), F.lit("(missing)")) if color else F.lit("(all)")).alias("g"),
    ).dropna(subset=["x", "y", *(["s"] if size else [])])

    def line(frame: DataFrame, keys) -> DataFrame:
        s = frame.groupBy(*keys).agg(
            F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("intercept"), F.regr_sxy("y", "x").alias("_sxy"),
            F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"))
        # corr() fails where one side is constant
        s = s.withColumn("r", F.expr("greatest(-1D, least(1D, _sxy / nullif(sqrt(_sxx) * sqrt(_syy), 0)))"))
        s = s.withColumn("r", F.expr("CASE WHEN _sxx > 0 AND _syy > 0 THEN r END"))
        se = F.expr("sqrt((1 - r * r) * _syy / nullif(_sxx, 0) / nullif(n - 2, 0))")
        p = dist.t_sf2(F.col("slope") / F.nullif(se, F.lit(0.0)), F.col("n") - 2)
        return s.select(
            *keys, "n", "slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r_squared"),
            se.alias("stderr"), F.when(se == 0, 0.0).otherwise(p).alias("p_value"))  # points on a line leave no error

    whole = line(rows.withColumn("g", F.lit("(all)")), ["g"]).withColumnRenamed("g", "group")
    if not color:
        return whole
    if max_groups is not None and rows.select("g").distinct().limit(max_groups + 1).count() > max_groups:
        raise Refusal(f"scatter: '{color}' has more than {max_groups} groups")
    return whole.unionByName(line(rows, ["g"]).withColumnRenamed("g", "group"))


def scatter_points(df: DataFrame, rid: str, x: str, y: str, color=None, size=None, limit=2000, seed=0):
    """A seeded sample of complete rows, the same on every run, with the size range of ALL rows."""
    names = [c for c in (x, y, size, color) if c]
    need_columns(df, [rid, *names])
    rows = df.select(rid, *[quoted(c) for c in names]).dropna(subset=[c for c in names if c != color])
    if color:
        rows = rows.withColumn(color, F.coalesce(quoted(color).cast("string"), F.lit("(missing)")))
    if size:
        lo, hi = rows.agg(F.min(size), F.max(size)).first()
        rows = rows.withColumn("size_min", F.lit(lo)).withColumn("size_max", F.lit(hi))
    return rows.orderBy(F.xxhash64(F.col(rid), F.lit(seed)), rid).limit(limit)


def group_comparison(df: DataFrame, column: str, group_by: str) -> DataFrame:
    """count, mean, std, median and a t interval per group; groups of one stay in the table."""
    return group_summary(df, column, group_by)


def group_comparison_test(df: DataFrame, column: str, group_by: str) -> DataFrame:
    """Welch t for two testable groups, one-way F for more; groups of one leave the test."""
    every = group_moments(labelled(df, group_by, column))
    moments = every.where("n > 1")
    k = moments.limit(3).count()
    dropped = F.lit(every.where("n <= 1").count())
    if k < 2:
        raise Refusal("group_comparison: fewer than two groups with two or more values")
    if k == 2:
        row = mean_difference(two_groups(moments, [], "group_comparison"), equal_var=False)
        t = F.expr("mean_difference / nullif(se, 0)")
        return row.select(
            F.lit("welch_t").alias("test"), t.alias("statistic"), "dof",
            F.lit(None).cast("double").alias("dof_within"), F.expr("n1 + n2").alias("n"),
            dropped.alias("n_groups_dropped"), dist.t_sf2(t, F.col("dof")).alias("p_value"))
    f = one_way(moments, [])
    return f.select(
        F.lit("one_way_f").alias("test"), "statistic", F.col("dof_between").cast("double").alias("dof"),
        F.col("dof_within").cast("double").alias("dof_within"), "n", dropped.alias("n_groups_dropped"),
        dist.f_sf(F.col("statistic"), F.col("dof_between"), F.col("dof_within")).alias("p_value"))
