"""Series on a regular grid: spacing, gaps, decomposition, correlation, stationarity.

Rows are aggregated to periods before anything else, so only periods ever meet in one window or one
kernel: a calendar of ten thousand years has 3.65 million days, however many rows there are. ``by`` runs a
fleet of series in one job.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import dtype_of, is_date, number, quoted, seconds
from tallywork.operators.means import _attach
from tallywork.operators.ordering import grouped_quantiles, previous_row
from tallywork.operators.tables import calendar, grouped, period_end
from tallywork.operators import series_kernels as kernels
from tallywork.session import cut_lineage

FREQS = {"D": 1.0, "W": 7.0, "ME": 30.44, "QE": 91.31, "YE": 365.25}  # nominal days
SEASON = {"D": 7, "W": 52, "ME": 12, "QE": 4}
MIN_PERIODS, MAX_EMPTY = 12, 0.2
MAX_LAGS, MAX_DIFFERENCES, MIN_RESIDUAL = 60, 2, 10


# -------------------------------------------------------------------------- the grid


def _nearest(days: Column) -> Column:
    """Nominal frequency closest to a gap on a log scale."""
    names, lengths = list(FREQS), list(FREQS.values())
    out = F.lit(names[-1])
    for i in range(len(names) - 2, -1, -1):
        out = F.when(days < math.sqrt(lengths[i] * lengths[i + 1]), names[i]).otherwise(out)
    return out


def infer_frequency(df: DataFrame, date: str, by=()) -> DataFrame:
    """Median gap between distinct dates, and the calendar frequency nearest to it."""
    by = list(by)
    need_columns(df, [date, *by])
    at = seconds(quoted(date).cast("timestamp_ntz")).alias("t")
    points = df.where(quoted(date).isNotNull()).select(*by, at).distinct()
    if by:
        gaps = points.withColumn("p", F.lag("t").over(W.partitionBy(*by).orderBy("t")))
    else:
        gaps = previous_row(points, "t", {"t": "p"})
    gaps = gaps.select(*(by or [F.lit(0).alias("_all")]), ((F.col("t") - F.col("p")) / 86400).alias("gap"))
    medians = grouped_quantiles(gaps, "gap", {"median_gap_days": 0.5}, by or ["_all"])
    return medians.select(*by, "median_gap_days", _nearest(F.col("median_gap_days")).alias("freq"))


def _with_frequency(df, date, freq, by=()) -> tuple[DataFrame, list[str]]:
    """Rows with the frequency of their series as ``_freq``, and the frequencies that occur.

    Without ``freq`` every series is measured on its own dates; one with a single date has one period
    at any frequency and takes the first that occurs. Frequencies are joined only where they differ.
    """
    by = list(by)
    need_columns(df, [date, *by])
    if not is_date(dtype_of(df, date)):
        raise Refusal(f"'{date}' is not a date column")
    if freq is not None:
        if freq not in FREQS:
            raise Refusal(f"unknown frequency {freq!r} (allowed: {list(FREQS)})")
        return df.withColumn("_freq", F.lit(freq)), [freq]
    own = infer_frequency(df, date, by).select(
        *by, F.when(F.col("median_gap_days").isNotNull(), F.col("freq")).alias("_freq"))
    own = cut_lineage(own)  # one row a series
    found = {r["_freq"] for r in own.select("_freq").distinct().collect()}  # at most one row a frequency
    freqs = [f for f in FREQS if f in found]
    if not freqs:
        raise Refusal("a time series needs at least two distinct timestamps")
    if len(freqs) == 1:
        return df.withColumn("_freq", F.lit(freqs[0])), freqs
    return df.join(own, by, "left").fillna(freqs[0], ["_freq"]), freqs


def _each(freqs: list[str], make) -> Column:
    """``make(freq)`` for the frequency of the row's series."""
    out = make(freqs[-1])
    for freq in reversed(freqs[:-1]):
        out = F.when(F.col("_freq") == freq, make(freq)).otherwise(out)
    return out


def _n_periods(first: Column, last: Column, freq: str) -> Column:
    """Number of periods from ``first`` to ``last`` (both period ends), as ``calendar`` lists them."""
    if freq in ("D", "W"):
        steps = F.datediff(last, first) / int(FREQS[freq])
    else:
        months = 12 * (F.year(last) - F.year(first)) + F.month(last) - F.month(first)
        steps = months / {"ME": 1, "QE": 3, "YE": 12}[freq]
    return F.floor(steps).cast("long") + 1


def _cells(df, date, values, freqs, agg, by) -> DataFrame:
    """One row per (by, period) that holds rows, with row counts."""
    rows = df.select(
        *by, "_freq", _each(freqs, lambda f: period_end(quoted(date), f)).alias("period"), quoted(date).alias("_at"),
        *[number(quoted(v)).alias(v) for v in values]).dropna()
    keys = [*by, "_freq", "period"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    for v in values:
        cells = cells.join(grouped(rows, keys, v, agg, v), keys)
    return cells


def series_report(df, date, values, freq=None, agg="mean", by=(), max_periods=None) -> DataFrame:
    """Per series: rows used, duplicate timestamps, periods, empty ones, its frequency, and the reason for
    refusing it (null when it can be analysed). Periods are counted from first and last."""
    by, values = list(by), [values] if isinstance(values, str) else list(values)
    rows, freqs = _with_frequency(df, date, freq, by)
    cells = _cells(rows, date, values, freqs, agg, by)
    missing = F.count_if(F.array_contains(F.array(*[F.col(v).isNull() for v in values]), True))
    counts = cells.groupBy(*by).agg(
        F.coalesce(F.first("_freq"), F.lit(freqs[0])).alias("_freq"), F.min("period").alias("_a"),
        F.max("period").alias("_z"), F.sum("n_rows").alias("n_used"), F.count("*").alias("_n"), missing.alias("_m"))
    n_periods = F.coalesce(_each(freqs, lambda f: _n_periods(F.col("_a"), F.col("_z"), f)), F.lit(0).cast("long"))
    counts = counts.withColumn("n_periods", n_periods).select(
        *by, "n_periods", "n_used", (F.col("n_periods") - F.col("_n")).alias("n_empty"),
        (F.col("n_periods") - F.col("_n") + F.col("_m")).alias("n_interpolated"), F.col("_freq").alias("freq"))
    stamps = df.dropna(subset=[date, *values]).groupBy(*by, date).agg(F.count("*").alias("c")).groupBy(*by).agg(
        F.sum(F.col("c") - 1).alias("n_duplicate_timestamps"))
    reason = F.when(F.col("n_periods") < MIN_PERIODS, f"fewer than {MIN_PERIODS} periods").when(
        F.col("n_empty") / F.col("n_periods") > MAX_EMPTY, "too many empty periods")
    if max_periods is not None:
        reason = F.when(F.col("n_periods") > max_periods, f"more than {max_periods} periods").otherwise(reason)
    return _attach(counts, stamps, by).select(
        *by, "n_periods", "n_used", "n_empty", "n_interpolated", "n_duplicate_timestamps", "freq", reason.alias("refused"))


def regular_grid(df, date, values, freq=None, agg="mean", by=(), minimum=MIN_PERIODS, max_periods=None) -> DataFrame:
    """Periods with values, time-weighted interpolation of empty ones, and a running index.

    A single series that is too short or too gappy (or above ``max_periods``, if given) is refused; in a
    fleet such series are left out (``series_report`` lists them with the reason). Series of a fleet
    without ``freq`` each have their own, in the column ``freq``. A series is judged by counts before its gaps are
    opened, so that no more than a fifth of its periods is ever made up; a gap is opened from the period before it.
    """
    by, values = list(by), [values] if isinstance(values, str) else list(values)
    need_columns(df, values)
    rows, freqs = _with_frequency(df, date, freq, by)
    grid = _grid(rows, date, values, freqs, agg, by, minimum, max_periods)
    return grid.withColumnRenamed("_freq", "freq") if by and freq is None else grid.drop("_freq")


def _grid(rows, date, values, freqs, agg, by, minimum=MIN_PERIODS, max_periods=None) -> DataFrame:
    period, whole = F.col("period"), W.partitionBy(*by)
    cells = _cells(rows, date, values, freqs, agg, by).withColumns({
        "_a": F.min("period").over(whole), "_z": F.max("period").over(whole), "_cells": F.count("*").over(whole)})
    cells = cells.withColumn("n", _each(freqs, lambda f: _n_periods(F.col("_a"), F.col("_z"), f)))
    sound = (F.col("n") >= minimum) & (F.col("n") - F.col("_cells") <= MAX_EMPTY * F.col("n"))
    if max_periods is not None:
        sound = sound & (F.col("n") <= max_periods)
    if by:
        cells = cells.where(sound)
    else:
        stop = F.raise_error(F.lit("too few, too many or too many empty periods for a series"))
        cells = cells.where(F.when(sound, True).otherwise(stop.cast("boolean")))
    # both directions carry values forward: a frame that looks ahead would be read anew for every row
    up, down = whole.orderBy("period"), whole.orderBy(F.col("period").desc())
    back, ahead = up.rowsBetween(W.unboundedPreceding, 0), down.rowsBetween(W.unboundedPreceding, -1)
    carried = {"_next": F.lead("period").over(up)}
    for i, v in enumerate(values):
        known = F.when(F.col(v).isNotNull(), F.struct(period.alias("t"), F.col(v).alias("v")))
        carried |= {f"_lo{i}": F.last(known, ignorenulls=True).over(back),
                    f"_hi{i}": F.last(known, ignorenulls=True).over(ahead)}

    def until_next(f):
        steps = (_n_periods(period, F.col("_next"), f) - 1).cast("int")
        return F.slice(calendar(period, F.col("_next"), f), F.lit(1), steps)

    listed = F.when(F.col("_next").isNull(), F.array(period)).otherwise(_each(freqs, until_next))
    grid = cells.withColumns(carried).withColumn("_period", F.explode(listed))
    day, here = F.unix_date("_period"), F.col("_period") == period
    filled, missing = {}, ~here
    for i, v in enumerate(values):
        lo, hi = F.col(f"_lo{i}.v"), F.col(f"_hi{i}.v")
        t0, t1 = F.unix_date(f"_lo{i}.t"), F.unix_date(f"_hi{i}.t")
        between = lo + (hi - lo) * (day - t0) / (t1 - t0)
        filled[v] = F.coalesce(F.when(here, F.col(v)), between, lo, hi).cast("double")
        missing = missing | F.col(v).isNull()
    idx = _each(freqs, lambda f: _n_periods(F.col("_a"), F.col("_period"), f) - 1).cast("int")
    return grid.select(
        *by, F.col("_period").alias("period"), idx.alias("idx"), "n",
        *[e.alias(v) for v, e in filled.items()], missing.alias("was_interpolated"), "_freq")


def season_length(freq: str, declared: int | None = None) -> int:
    if declared is not None:
        if declared < 2:
            raise Refusal(f"seasonal_period must be at least 2, got {declared}")
        return int(declared)
    if freq not in SEASON:
        raise Refusal(f"{freq} data has no implied cycle; give seasonal_period")
    return SEASON[freq]


# --------------------------------------------------------------------- decomposition


def decompose_classical(grid: DataFrame, value: str, period: int, by=()) -> DataFrame:
    """Centred moving average, mean per phase, remainder; additive."""
    by = list(by)
    half = period // 2
    w = W.partitionBy(*by).orderBy("idx")
    total = F.sum(value).over(w.rowsBetween(-half, half))
    if period % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    inside = (F.col("idx") >= half) & (F.col("idx") < F.col("n") - half)
    short = F.col("n") < 2 * period
    x = grid.withColumn("trend", F.when(inside & ~short, total / period))
    x = x.withColumn("_phase", F.col("idx") % period)
    phase = W.partitionBy(*by, "_phase")
    x = x.withColumn("_s", F.avg(F.col(value) - F.col("trend")).over(phase))
    # every phase counts once in the centring, whichever phases the series ends on
    first = F.when(F.col("idx") < period, F.col("_s"))
    x = x.withColumn("seasonal", F.col("_s") - F.avg(first).over(W.partitionBy(*by)))
    return x.select(
        *by, "period", "idx", "n", F.col(value).alias("observed"), "trend", "seasonal",
        (F.col(value) - F.col("trend") - F.col("seasonal")).alias("residual"))


def _per_series(grid: DataFrame, by: list[str], kernel, out: str) -> DataFrame:
    """Run a small numeric kernel on each series (bounded by the calendar)."""
    keyed = grid if by else grid.withColumn("_one", F.lit(0))
    keys = by or ["_one"]
    key_schema = ", ".join(f"`{k}` {dict(keyed.dtypes)[k]}" for k in keys)

    def run(key, pdf):
        frame = kernel(pdf.sort_values("idx"))
        for at, (name, value) in enumerate(zip(keys, key)):
            frame.insert(at, name, value)
        return frame

    result = keyed.groupBy(*keys).applyInPandas(run, f"{key_schema}, {out}")
    return result if by else result.drop("_one")


def decompose_stl(grid: DataFrame, value: str, period: int, by=()) -> DataFrame:
    """Seasonal-trend decomposition by LOESS: window of two cycles, seasonal degree 0."""
    split = kernels.stl

    def kernel(pdf):
        import pandas as pd

        y = pdf[value].to_numpy(dtype=float)
        trend, seasonal = split(y, period)
        return pd.DataFrame({
            "period": pdf["period"], "idx": pdf["idx"], "n": pdf["n"], "observed": y, "trend": trend,
            "seasonal": seasonal, "residual": y - trend - seasonal})

    columns = [*by, "period", "idx", "n", value]
    return _per_series(
        grid.select(*columns).where(F.col("n") >= 3 * period), list(by), kernel,
        "period date, idx int, n long, observed double, trend double, seasonal double, residual double")


def decompose(df, date, value, freq=None, agg="mean", seasonal_period=None, by=()) -> DataFrame:
    """STL with three cycles or more, the classical form with two, refused below.

    Series of a fleet have the cycle of their own frequency; those whose frequency implies none are left
    out, unless that leaves no frequency."""
    by = list(by)
    rows, freqs = _with_frequency(df, date, freq, by)
    cyclic = [f for f in freqs if seasonal_period is not None or f in SEASON] or freqs
    periods = {f: season_length(f, seasonal_period) for f in cyclic}
    grid = _grid(rows, date, [value], freqs, agg, by)
    if not by:
        n, period = grid.count(), periods[freqs[0]]
        if n < 2 * period:
            raise Refusal(f"decompose: {n} periods are fewer than two cycles of {period}")
        return (decompose_stl if n >= 3 * period else decompose_classical)(grid, value, period, by)
    parts = []
    for f, period in periods.items():
        of = grid.where(F.col("_freq") == f)
        two = of.where((F.col("n") >= 2 * period) & (F.col("n") < 3 * period))
        parts += [decompose_stl(of, value, period, by), decompose_classical(two, value, period, by)]
    return reduce(DataFrame.unionByName, parts)


def component_strength(parts: DataFrame, by=()) -> DataFrame:
    """How much of a component and the noise together is the component, in [0, 1]."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.var_samp("residual") / F.expr(
        f"nullif(var_samp(residual + {c}), 0)")))
    return parts.groupBy(*by).agg(
        share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength"),
        (F.max("seasonal") - F.min("seasonal")).alias("peak_to_trough"))


def trend_slope(parts: DataFrame, by=()) -> DataFrame:
    """Least-squares slope of the trend per period, with a t interval."""
    known = parts.where("trend IS NOT NULL")
    s = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("trend", "idx").alias("slope"),
        F.regr_sxx("trend", "idx").alias("sxx"), F.regr_syy("trend", "idx").alias("syy"),
        F.regr_sxy("trend", "idx").alias("sxy"))
    s = s.withColumn("stderr", F.expr("sqrt(greatest(0D, syy - sxy * sxy / sxx) / sxx / (n - 2))"))
    margin = dist.t_ppf(F.lit(0.975), F.col("n") - 2) * F.col("stderr")
    return s.select(*by, "n", "slope", "stderr", (F.col("slope") - margin).alias("ci95_low"),
                    (F.col("slope") + margin).alias("ci95_high"))


# ------------------------------------------------------------------- autocorrelation


def default_lags(n: int, lags: int | None = None) -> int:
    ceiling = max(1, min(n // 4, MAX_LAGS))
    if lags is None:
        return min(max(1, round(10 * math.log10(max(n, 10)))), ceiling)
    if lags < 1:
        raise Refusal(f"autocorrelation: lags must be at least 1, got {lags}")
    return min(lags, ceiling)


def _own_lags(n: Column, lags: int | None) -> Column:
    """``default_lags`` for a column of lengths."""
    wanted = F.lit(lags) if lags else F.rint(10 * F.log10(F.greatest(n, F.lit(10))))
    return F.least(F.greatest(F.lit(1), wanted), F.greatest(F.lit(1), F.least(F.floor(n / 4), F.lit(MAX_LAGS))))


def autocovariances(grid: DataFrame, value: str, lags: int, by=()) -> DataFrame:
    """Rows (by, lag, n, c) of centred lagged products, lag 0 included: one sort, one pass."""
    by = list(by)
    order = W.partitionBy(*by).orderBy("idx")
    x = grid.withColumn("_c", F.col(value) - F.avg(value).over(W.partitionBy(*by)))
    x = x.select(*by, "n", "_c", *[(F.col("_c") * F.lag("_c", k).over(order)).alias(f"_p{k}") for k in range(1, lags + 1)])
    sums = x.groupBy(*by).agg(
        F.first("n").alias("n"),
        F.array(F.sum(F.col("_c") * F.col("_c")), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)) for k in range(1, lags + 1)])
        .alias("_all"))
    return sums.select(*by, "n", F.posexplode("_all").alias("lag", "c"))


def autocorrelation(grid: DataFrame, value: str, lags: int | None = None, by=()) -> DataFrame:
    """ACF and PACF with 95 % bands. Every series of a fleet has the lags its own length allows."""
    by = list(by)
    longest = grid.agg(F.max("n")).first()[0]
    if longest is None:
        raise Refusal("autocorrelation: no usable series")
    own = _own_lags(F.col("n"), lags)
    cov = autocovariances(grid, value, default_lags(longest, lags), by).where(F.col("lag") <= own)
    whole, order = W.partitionBy(*by), W.partitionBy(*by).orderBy("lag")
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(whole)
    r = cov.withColumn("acf", F.col("c") / F.when(zero > 0, zero)).withColumn(
        "adjusted", F.col("acf") * F.col("n") / (F.col("n") - F.col("lag")))
    earlier = F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(
        order.rowsBetween(W.unboundedPreceding, -1))
    r = r.withColumn("_band", F.lit(dist.norm_point(0.975)) * F.sqrt(
        (1 + 2 * F.coalesce(earlier, F.lit(0.0))) / F.col("n")))
    levinson = kernels.partial_autocorrelations

    @F.pandas_udf("array<double>")
    def partial(columns):
        import pandas as pd

        return pd.Series([levinson(c) for c in columns])

    partial.__name__ = "partial"
    listed = r.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("lag", "adjusted"))).alias("_l"))  # at most 61
    solved = listed.select(*by, partial(F.expr("transform(_l, s -> s.adjusted)")).alias("_pacf"))
    both = _attach(r.where("lag > 0"), solved, by).withColumn("pacf", F.get("_pacf", F.col("lag") - 1))
    width = F.lit(dist.norm_point(0.975)) / F.sqrt("n")
    return both.select(
        *by, "lag", "n", "acf", (F.col("acf") - F.col("_band")).alias("acf_low"),
        (F.col("acf") + F.col("_band")).alias("acf_high"),
        (F.abs("acf") > F.col("_band")).alias("acf_outside"), "pacf",
        (F.col("pacf") - width).alias("pacf_low"), (F.col("pacf") + width).alias("pacf_high"),
        (F.abs("pacf") > width).alias("pacf_outside"))


def ljung_box(grid: DataFrame, value: str, lags: int, model_df: int = 0, by=()) -> DataFrame:
    """Joint test that the first lags are uncorrelated; at most a fifth of the series."""
    by = list(by)
    cov = autocovariances(grid, value, lags, by)
    zero = F.max(F.when(F.col("lag") == 0, F.col("c"))).over(W.partitionBy(*by))
    r = cov.withColumn("acf", F.col("c") / F.when(zero > 0, zero)).withColumn(
        "usable", F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(F.col("n") / 5))))
    q = r.where("lag > 0 AND lag <= usable").groupBy(*by).agg(
        F.first("n").alias("n"), F.first("usable").cast("long").alias("lags"),
        F.sum(F.expr("acf * acf / (n - lag)")).alias("s"))
    q = q.withColumn("statistic", F.expr(f"CASE WHEN n >= 8 AND lags > {model_df} THEN n * (n + 2) * s END"))
    q = q.withColumn("dof", F.greatest(F.lit(1), F.col("lags") - model_df))
    return q.select(*by, "n", "lags", "statistic", "dof", dist.chi2_sf(F.col("statistic"), F.col("dof")).alias("p_value"))


# ----------------------------------------------------------------------- stationarity

ADF = "statistic double, p_value double, lags_used int, n_obs int, critical_1 double, critical_5 double, critical_10 double"


def adf_test(grid: DataFrame, value: str, regression: str = "c", by=()) -> DataFrame:
    """Augmented Dickey-Fuller with the lag chosen by AIC and MacKinnon's p-value."""
    _check_regression(regression)
    test = kernels.adf

    def kernel(pdf):
        import pandas as pd

        return pd.DataFrame([test(pdf[value].to_numpy(dtype=float), regression)])

    return _per_series(grid.select(*by, "idx", value), list(by), kernel, ADF).withColumn(
        "rejects_unit_root", F.col("p_value") < 0.05)


def kpss_test(grid: DataFrame, value: str, regression: str = "c", by=()) -> DataFrame:
    """KPSS with data-dependent lag; the p-value is a bound at the edges of its table."""
    _check_regression(regression)
    test = kernels.kpss

    def kernel(pdf):
        import pandas as pd

        return pd.DataFrame([test(pdf[value].to_numpy(dtype=float), regression)])

    return _per_series(grid.select(*by, "idx", value), list(by), kernel,
                       "statistic double, p_value double, p_is_bound boolean, lags_used int").withColumn(
        "rejects_stationarity", F.col("p_value") < 0.05)


def _check_regression(regression: str) -> None:
    if regression not in ("c", "ct"):
        raise Refusal(f"unknown regression {regression!r} (allowed: 'c', 'ct')")


def stationarity_test(grid: DataFrame, value: str, regression: str = "c", by=()) -> DataFrame:
    """ADF and KPSS read together, the differences needed, and the lag-1 autocorrelation."""
    by = list(by)
    a = adf_test(grid, value, regression, by).select(
        *by, F.col("statistic").alias("adf_statistic"), F.col("p_value").alias("adf_p"),
        F.col("lags_used").alias("adf_lags"), "rejects_unit_root")
    k = kpss_test(grid, value, regression, by).select(
        *by, F.col("statistic").alias("kpss_statistic"), F.col("p_value").alias("kpss_p"),
        F.col("lags_used").alias("kpss_lags"), "rejects_stationarity")
    needed = differences_needed(grid, value, regression, by)
    cov = autocovariances(grid, value, 1, by).groupBy(*by).agg(
        (F.max(F.when(F.col("lag") == 1, F.col("c"))) / F.max(F.when(F.col("lag") == 0, F.col("c")))).alias("lag1"))
    out = _attach(_attach(_attach(a, k, by), needed, by), cov, by)
    return out.withColumn("verdict", F.expr(
        "CASE WHEN rejects_unit_root AND NOT rejects_stationarity THEN 'stationary' "
        "WHEN NOT rejects_unit_root AND rejects_stationarity THEN 'unit_root' "
        "WHEN rejects_unit_root THEN 'trend_or_break' ELSE 'inconclusive' END"))


def differences_needed(grid: DataFrame, value: str, regression: str = "c", by=()) -> DataFrame:
    test = kernels.adf

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        y = pdf[value].to_numpy(dtype=float)
        for order in range(MAX_DIFFERENCES + 1):
            if y.size < MIN_RESIDUAL:
                return pd.DataFrame([{"differences": order}])
            p = test(y, regression)["p_value"]
            if p is None or p < 0.05:
                return pd.DataFrame([{"differences": order}])
            y = np.diff(y)
        return pd.DataFrame([{"differences": MAX_DIFFERENCES + 1}])

    return _per_series(grid.select(*by, "idx", value), list(by), kernel, "differences int")


def difference_to_stationarity(grid: DataFrame, values: list[str], by=()) -> DataFrame:
    """Difference all columns together, per series, until ADF rejects a unit root in each.

    Returns the differenced rows with the order used; a series still failing after two
    differences is refused (left out of a fleet).
    """
    by, current = list(by), grid
    order = W.partitionBy(*by).orderBy("idx")
    done = None
    for applied in range(MAX_DIFFERENCES + 1):
        verdicts = None
        for v in values:
            one = adf_test(current, v, "c", by).select(*by, F.col("rejects_unit_root").alias(f"_{v}"))
            verdicts = one if verdicts is None else _attach(verdicts, one, by)
        passed = verdicts.select(*by, F.array_contains(F.array(*[F.coalesce(F.col(f"_{v}"), F.lit(False)) for v in values]), False).alias("_bad"))
        marked = _attach(current, passed, by)
        good = marked.where("NOT _bad").drop("_bad").withColumn("differences", F.lit(applied))
        done = good if done is None else done.unionByName(good)
        if not by:
            if not passed.first()["_bad"]:
                return good
        current = marked.where("_bad").drop("_bad")
        current = current.withColumns({
            v: F.col(v) - F.lag(v).over(order) for v in values}).dropna(subset=values)
    if not by:
        raise Refusal(f"the series remain non-stationary after {MAX_DIFFERENCES} differences")
    return done


def granger_causality(grid: DataFrame, value: str, cause: str, max_lag: int | None = None, by=()) -> DataFrame:
    """F test per lag that past values of the cause improve the forecast, adjusted over the
    lags, with the summed coefficient and its interval."""
    if value == cause:
        raise Refusal("granger_causality: cause and value must be different columns")
    by = list(by)
    ready = difference_to_stationarity(grid, [value, cause], by)
    tests = kernels.granger

    def kernel(pdf):
        import pandas as pd

        n = len(pdf)
        ceiling = max(1, min((n // 4) // 2, MAX_LAGS))
        lags = min(max_lag or 4, ceiling)
        rows = tests(pdf[value].to_numpy(dtype=float), pdf[cause].to_numpy(dtype=float), lags)
        return pd.DataFrame([{**r, "differences": int(pdf["differences"].iloc[0])} for r in rows])

    out = _per_series(
        ready.select(*by, "idx", value, cause, "differences"), by, kernel,
        "lag int, f_statistic double, df_num int, df_denom int, p_value double, partial_eta_squared double, "
        "summed_coefficient double, ci95_low double, ci95_high double, differences int")
    whole = W.partitionBy(*by)
    ranked = out.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("p_value", "lag")))
    step = F.col("p_value") * F.count("*").over(whole) / F.col("_r")
    later = W.partitionBy(*by).orderBy("_r").rowsBetween(0, W.unboundedFollowing)
    return ranked.withColumn("_q", step).withColumn(
        "p_adjusted", F.least(F.lit(1.0), F.min("_q").over(later))).drop("_r", "_q")


# --------------------------------------------------------------------------- forecast


def forecast(
    grid: DataFrame, value: str, freq: str | None, horizon: int = 12, order=(1, 0, 0), seasonal=(0, 0, 0),
    season: int = 0, by=()
) -> DataFrame:
    """ARIMA per series by conditional sum of squares: forecasts with 95 % intervals and the
    fit's coefficients, information criteria and residual sum beside them. Without ``freq`` each
    series goes on at the frequency in the grid's column ``freq``."""
    if any(seasonal) and season < 2:
        raise Refusal("forecast: a seasonal order needs a season of at least 2")
    needed = sum(order) + sum(seasonal) * max(season, 1) + MIN_RESIDUAL
    by, freqs = list(by), [freq] if freq else list(FREQS)
    grid = grid.withColumn("_freq", F.lit(freq) if freq else F.col("freq"))
    fit = kernels.arima

    def kernel(pdf):
        import pandas as pd

        rows = fit(pdf[value].to_numpy(dtype=float), order, seasonal, season, horizon)
        frame = pd.DataFrame(rows)
        frame["period"] = pdf["period"].iloc[-1]
        return frame

    out = _per_series(
        grid.select(*by, "_freq", "period", "idx", "n", value).where(F.col("n") >= needed), [*by, "_freq"], kernel,
        "step int, forecast double, low double, high double, coefficients array<double>, sigma2 double, "
        "aic double, bic double, period date")
    step = F.col("step")
    moved = {
        "D": F.date_add("period", step), "W": F.date_add("period", step * 7),
        "ME": F.last_day(F.add_months("period", step)),
        "QE": F.last_day(F.add_months("period", step * 3)), "YE": F.last_day(F.add_months("period", step * 12))}
    moved = out.withColumn("period", _each(freqs, moved.get)).withColumn("estimator", F.lit("css"))
    return moved.drop("_freq") if freq else moved.withColumnRenamed("_freq", "freq")
