"""Grouped summaries, counts, cross tables, bins and calendar resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywork.errors import Refusal, need_columns
from tallywork.functions.cells import dtype_of, is_date, is_number, number, quoted
from tallywork.functions.predicates import predicate
from tallywork.operators.ordering import exact_quantiles, grouped_quantiles

AGGREGATES = ["sum", "mean", "median", "min", "max", "std", "var", "count", "nunique"]
NUMERIC_ONLY = {"sum", "mean", "median", "std", "var"}
KEEPS_NULLS = {"count", "nunique"}


def analysis_filter(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:
    """The one optional row filter applied before any analysis."""
    return df.where(predicate(df, column, operator, value))


def _check_aggregate(df: DataFrame, column: str, agg: str) -> None:
    need_columns(df, [column])
    if agg not in AGGREGATES:
        raise Refusal(f"Unknown aggregate: {agg}. Supported: {AGGREGATES}")
    if agg in NUMERIC_ONLY and not is_number(dtype_of(df, column)):
        raise Refusal(f"Aggregate '{agg}' needs a numeric column, '{column}' is not")


def _aggregate(c: Column, agg: str, kind) -> Column:
    x = number(c) if agg in ("mean", "std", "var") else c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = number(c)
    return {
        "sum": F.sum(c), "mean": F.avg(x), "min": F.min(c), "max": F.max(c),
        "std": F.stddev_samp(x), "var": F.var_samp(x), "count": F.count(c),
        "nunique": F.count_distinct(c),
    }[agg]


def grouped(df: DataFrame, keys: list[str], column: str, agg: str, out: str) -> DataFrame:
    """One aggregate per group. Distinct counts and medians stay safe for hot groups:
    both first collapse to one row per distinct value on the map side."""
    if agg == "median":
        return grouped_quantiles(df, column, {out: 0.5}, keys)
    return df.groupBy(*[quoted(k) for k in keys]).agg(
        _aggregate(quoted(column), agg, dtype_of(df, column)).alias(out)
    )


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max: one row per statistic, one column per input."""
    columns = columns or [f.name for f in df.schema if is_number(f.dataType)]
    if not columns:
        raise Refusal("describe: no numeric columns")
    need_columns(df, columns)
    cols = {c: number(quoted(c)) for c in columns}
    quarts = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    stats = {
        "count": lambda c: F.count(cols[c]).cast("double"),
        "mean": lambda c: F.avg(cols[c]),
        "std": lambda c: F.stddev_samp(cols[c]),
        "min": lambda c: F.min(cols[c]),
        "25%": lambda c: F.lit(quarts[c][0]),
        "50%": lambda c: F.lit(quarts[c][1]),
        "75%": lambda c: F.lit(quarts[c][2]),
        "max": lambda c: F.max(cols[c]),
    }
    rows = [
        F.struct(F.lit(s).alias("statistic"), *[stats[s](c).cast("double").alias(c) for c in columns])
        for s in stats
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def groupby_aggregate(df: DataFrame, group_by: list[str], column: str, agg: str) -> DataFrame:
    """Null keys leave; null targets leave except for count and nunique; largest first."""
    need_columns(df, group_by)
    _check_aggregate(df, column, agg)
    kept = df.dropna(subset=[*group_by, *([] if agg in KEEPS_NULLS else [column])])
    if kept.isEmpty():
        raise Refusal(f"groupby_aggregate: no rows remain after dropping nulls in {column!r}")
    out = f"{column}_{agg}"
    return grouped(kept, group_by, column, agg, out).orderBy(
        F.col(f"`{out}`").desc(), *[quoted(k) for k in group_by]
    )


def value_counts(df: DataFrame, column: str, top_n: int = 20, normalize: bool = False) -> DataFrame:
    need_columns(df, [column])
    kept = df.where(quoted(column).isNotNull())
    counts = kept.groupBy(quoted(column)).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.col("count").desc(), quoted(column)).limit(top_n)
    if not normalize:
        return top
    total = kept.count()
    return top.select(quoted(column), (F.col("count") / F.lit(total)).alias("proportion"))


def _levels(df: DataFrame, column: str, limit: int = 10_000) -> list:
    """Distinct non-null values for a pivot; they become columns, so the number is checked."""
    rows = (
        df.where(quoted(column).isNotNull()).select(quoted(column)).distinct().limit(limit + 1).collect()
    )
    if len(rows) > limit:
        raise Refusal(f"'{column}' has more than {limit} levels, too many for columns")
    return sorted(r[0] for r in rows)


def crosstab(df: DataFrame, row: str, column: str, normalize: bool = False) -> DataFrame:
    need_columns(df, [row, column])
    kept = df.dropna(subset=[row, column])
    levels = _levels(kept, column)
    names = [str(v) for v in levels]
    wide = kept.groupBy(quoted(row)).pivot(column, levels).count().fillna(0, subset=names)
    if not normalize:
        return wide
    total = sum((quoted(n) for n in names), F.lit(0))
    return wide.select(quoted(row), *[(quoted(n) / total).alias(n) for n in names])


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed, empty bins are kept."""
    need_columns(df, [column])
    x = number(quoted(column))
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        raise Refusal(f"histogram: column {column!r} has no non-null values")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(F.broadcast(counts), "bin", "left").select(  # one row per bin
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def top_n(df: DataFrame, column: str, by: str, n: int = 10, ascending: bool = False) -> DataFrame:
    need_columns(df, [column, by])
    wanted = [column] if column == by else [column, by]
    key = quoted(by).asc() if ascending else quoted(by).desc()
    return (
        df.select(*[quoted(c) for c in wanted]).dropna(subset=[by])
        .orderBy(key, *([quoted(column)] if column != by else [])).limit(n)
    )


def pivot(df: DataFrame, index: list[str], columns: str, values: str, agg: str) -> DataFrame:
    need_columns(df, [*index, columns])
    _check_aggregate(df, values, agg)
    kept = df.dropna(subset=[*index, columns, *([] if agg in KEEPS_NULLS else [values])])
    levels = _levels(kept, columns)
    if not levels:
        raise Refusal(f"pivot: no rows remain after dropping nulls in {[*index, columns, values]}")
    cells = grouped(kept, [*index, columns], values, agg, "_cell")
    return cells.groupBy(*[quoted(i) for i in index]).pivot(columns, levels).agg(F.first("_cell"))


PERIODS = {"D": "day", "W": "week", "ME": "month", "QE": "quarter", "YE": "year"}


def period_end(c: Column, freq: str) -> Column:
    """Last day of the period that holds ``c``; weeks end on Sunday."""
    day = c.cast("date")
    if freq == "D":
        return day
    if freq == "W":
        return F.next_day(F.date_sub(day, 1), "Sunday")
    if freq == "ME":
        return F.last_day(day)
    start = F.trunc(day, PERIODS[freq])
    return F.date_sub(F.add_months(start, 3 if freq == "QE" else 12), 1)


def calendar(first: Column, last: Column, freq: str) -> Column:
    """All period ends from ``first`` to ``last`` (both period ends), as an array."""
    if freq in ("D", "W"):
        step = F.expr("interval 1 day") if freq == "D" else F.expr("interval 7 days")
        return F.sequence(first, last, step)
    months = {"ME": 1, "QE": 3, "YE": 12}[freq]
    starts = F.sequence(
        F.trunc(first, "month"), F.trunc(last, "month"), F.expr(f"interval {months} months")
    )
    return F.transform(starts, F.last_day)


def resample(
    df: DataFrame, date_column: str, column: str, freq: str, agg: str, by: list[str] | None = None
) -> DataFrame:
    """Aggregate per calendar period; empty periods between first and last are present."""
    by = list(by or [])
    need_columns(df, [date_column, column, *by])
    if freq not in PERIODS:
        raise Refusal(f"Unknown frequency: {freq}. Supported: {list(PERIODS)}")
    if not is_date(dtype_of(df, date_column)):
        raise Refusal(f"resample: '{date_column}' is not a date column")
    _check_aggregate(df, column, agg)
    out = f"{column}_{agg}"
    kept = df.select(
        *by, period_end(quoted(date_column), freq).alias(date_column), quoted(column)
    ).dropna()
    cells = grouped(kept, [*by, date_column], column, agg, out)
    span = cells.groupBy(*by).agg(F.min(date_column).alias("_a"), F.max(date_column).alias("_z"))
    periods = span.select(
        *by, F.explode(calendar(F.col("_a"), F.col("_z"), freq)).alias(date_column)
    )
    filled = periods.join(cells, [*by, date_column], "left")
    if agg in KEEPS_NULLS or agg == "sum":
        return filled.fillna(0, subset=[out])
    return filled
