"""Time series on constructed data with known structure."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallywork.errors import Refusal
from tallywork.operators import series as s
from tallywork.operators import series_kernels as k

START = dt.datetime(2020, 1, 1)


def daily(spark, values, extra=None):
    rows = [(START + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp_ntz, value double")


def months(n):
    out, y, m = [], 2005, 1
    for _ in range(n):
        nxt = dt.datetime(y + m // 12, m % 12 + 1, 1)
        out.append(nxt - dt.timedelta(days=1))
        y, m = nxt.year, nxt.month
    return out


@pytest.fixture(scope="module")
def seasonal(spark):
    rows = [(d, 100 + 0.5 * i + 10 * math.sin(2 * math.pi * i / 12)) for i, d in enumerate(months(180))]
    return spark.createDataFrame(rows, "date timestamp_ntz, value double")


def test_frequency(spark, seasonal):
    assert s.infer_frequency(seasonal, "date").first()["freq"] == "ME"
    for step, freq in ((1, "D"), (7, "W"), (14, "W"), (91, "QE"), (365, "YE")):
        df = spark.createDataFrame([(START + dt.timedelta(days=step * i),) for i in range(6)], "date timestamp_ntz")
        assert s.infer_frequency(df, "date").first()["freq"] == freq


def test_grid_fills_gaps_by_time(spark):
    values = [float(i) for i in range(20)]
    values[5] = values[6] = None
    values[12] = 99.0
    grid = {r["idx"]: r for r in s.regular_grid(daily(spark, values), "date", "value", "D").collect()}
    assert len(grid) == 20 and grid[5]["value"] == pytest.approx(5.0) and grid[6]["value"] == pytest.approx(6.0)
    assert [i for i in grid if grid[i]["was_interpolated"]] == [5, 6]
    report = s.series_report(daily(spark, values), "date", "value", "D").first()
    assert (report["n_periods"], report["n_empty"], report["refused"]) == (20, 2, None)


def days_on_end(spark, n, name):
    return spark.range(n).selectExpr(
        f"'{name}' AS who", "CAST(date_add(DATE'1900-01-01', CAST(id AS int)) AS timestamp_ntz) AS date",
        "CAST(id % 9 AS double) AS value")


def test_long_series(spark):
    both = days_on_end(spark, 30_000, "long").where("dayofyear(date) <> 60").unionByName(days_on_end(spark, 40, "short"))
    report = {r["who"]: r for r in s.series_report(both, "date", "value", "D", by=["who"]).collect()}
    assert (report["long"]["n_periods"], report["long"]["n_empty"], report["long"]["refused"]) == (30_000, 82, None)
    assert (report["short"]["n_periods"], report["short"]["refused"]) == (40, None)
    grid = s.regular_grid(both, "date", "value", "D", by=["who"])
    rows = grid.where("who = 'long'").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(30_000))
    assert [r["period"] for r in rows] == [dt.date(1900, 1, 1) + dt.timedelta(days=i) for i in range(30_000)]
    for i, r in enumerate(rows):
        empty = r["period"].timetuple().tm_yday == 60
        want = ((i - 1) % 9 + (i + 1) % 9) / 2 if empty else i % 9
        assert r["was_interpolated"] == empty and r["value"] == pytest.approx(want)
    acf = s.autocorrelation(grid, "value", 9, by=["who"]).where("who = 'long' AND lag = 9").first()
    assert acf["n"] == 30_000 and acf["acf"] > 0.98


def test_longest_series_on_request(spark):
    both = days_on_end(spark, 300, "long").unionByName(days_on_end(spark, 40, "short"))
    report = s.series_report(both, "date", "value", "D", by=["who"], max_periods=200)
    assert {r["who"]: r["refused"] for r in report.collect()} == {"long": "more than 200 periods", "short": None}
    grid = s.regular_grid(both, "date", "value", "D", by=["who"], max_periods=200)
    assert {r["who"] for r in grid.select("who").distinct().collect()} == {"short"}
    with pytest.raises(PySparkException, match="too many"):
        s.regular_grid(days_on_end(spark, 300, "long"), "date", "value", "D", max_periods=200).collect()


def test_report_counts_periods_as_the_calendar(spark):
    days = [0, 3, 40, 41, 200, 395, 800, 1500]
    df = spark.createDataFrame([(START + dt.timedelta(days=d), float(d)) for d in days], "date timestamp_ntz, value double")
    for freq in s.FREQS:
        end = s.period_end(F.col("date"), freq)
        ends = df.agg(F.min(end).alias("a"), F.max(end).alias("z"))
        want = set(ends.select(s.calendar(F.col("a"), F.col("z"), freq)).first()[0])
        held = {r["p"] for r in df.select(end.alias("p")).collect()}
        report = s.series_report(df, "date", "value", freq).first()
        empty = len(want - held)
        assert (report["n_periods"], report["n_empty"], report["n_interpolated"]) == (len(want), empty, empty)


@pytest.mark.parametrize("freq", ["D", "W", "ME", "QE", "YE"])
def test_grid_is_the_calendar(spark, freq):
    """Gaps opened from the period before them, against one calendar from first to last."""
    rng = np.random.default_rng(3)
    step = int(s.FREQS[freq])
    kept = [i for i in range(60) if i in (0, 59) or rng.random() < 0.9]
    rows = [(START + dt.timedelta(days=step * i + 3), float(rng.integers(100))) for i in kept]
    df = spark.createDataFrame(rows, "date timestamp_ntz, value double")
    got = s.regular_grid(df, "date", "value", freq).orderBy("idx").collect()
    end = s.period_end(F.col("date"), freq)
    cells = {r["p"]: r["v"] for r in df.groupBy(end.alias("p")).agg(F.avg("value").alias("v")).collect()}
    periods = df.agg(F.min(end).alias("a"), F.max(end).alias("z")).select(s.calendar(F.col("a"), F.col("z"), freq)).first()[0]
    assert [r["period"] for r in got] == periods and [r["idx"] for r in got] == list(range(len(periods)))
    x = [p.toordinal() for p in periods]
    held = sorted(cells)
    want = np.interp(x, [p.toordinal() for p in held], [cells[p] for p in held])
    np.testing.assert_allclose([r["value"] for r in got], want)
    assert [r["was_interpolated"] for r in got] == [p not in cells for p in periods]


def test_periods_without_an_aggregate_are_interpolated(spark):
    # one row has no standard deviation: its period is there, but without a value
    rows = [(START + dt.timedelta(days=i), float(v)) for i in range(20) for v in ((0, i + 1) if i not in (0, 4, 5) else (7,))]
    df = spark.createDataFrame(rows, "date timestamp_ntz, value double")
    got = s.regular_grid(df, "date", "value", "D", "std").orderBy("idx").collect()
    root = math.sqrt(2)
    want = [(i + 1) / root for i in range(20)]
    want[0] = want[1]
    np.testing.assert_allclose([r["value"] for r in got], want)
    assert [r["idx"] for r in got if r["was_interpolated"]] == [0, 4, 5]


def test_grid_refuses(spark):
    with pytest.raises(PySparkException, match="too few"):
        s.regular_grid(daily(spark, range(5)), "date", "value", "D").collect()
    gappy = [float(i) if i % 3 == 0 else None for i in range(40)]
    with pytest.raises(PySparkException, match="empty"):
        s.regular_grid(daily(spark, gappy), "date", "value", "D").collect()
    with pytest.raises(Refusal):
        s.regular_grid(daily(spark, range(20)), "date", "value", "hourly")


@pytest.mark.parametrize("form", [s.decompose_classical, s.decompose_stl])
def test_decomposition_recovers_slope_and_amplitude(seasonal, form):
    parts = form(s.regular_grid(seasonal, "date", "value", "ME"), "value", 12)
    rows = [r for r in parts.collect() if r["trend"] is not None]
    assert all(r["observed"] == pytest.approx(r["trend"] + r["seasonal"] + r["residual"]) for r in rows)
    slope = s.trend_slope(parts).first()
    assert slope["slope"] == pytest.approx(0.5, abs=0.01)
    strength = s.component_strength(parts).first()
    assert strength["seasonal_strength"] > 0.98 and strength["trend_strength"] > 0.98
    assert strength["peak_to_trough"] == pytest.approx(20, abs=0.6)


def test_even_and_odd_periods_match_direct(spark):
    y = np.random.default_rng(1).normal(size=41)
    for period in (4, 5):
        grid = s.regular_grid(daily(spark, y), "date", "value", "D")
        rows = sorted(s.decompose_classical(grid, "value", period).collect(), key=lambda r: r["idx"])
        w = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
        trend = np.convolve(y, w, mode="valid")
        half = period // 2
        np.testing.assert_allclose([r["trend"] for r in rows[half:-half]], trend)
        assert rows[half - 1]["trend"] is None and rows[-half]["trend"] is None


def test_acf_pacf_ljung_box_direct(spark):
    y = np.random.default_rng(2).normal(size=120).cumsum()
    grid = s.regular_grid(daily(spark, y), "date", "value", "D")
    rows = sorted(s.autocorrelation(grid, "value", 8).collect(), key=lambda r: r["lag"])
    x = y - y.mean()
    r = np.array([(x[i:] * x[: 120 - i]).sum() / (x @ x) for i in range(9)])
    np.testing.assert_allclose([a["acf"] for a in rows], r[1:])
    adj = r * 120 / (120 - np.arange(9))
    for lag in range(1, 9):
        toeplitz = np.array([[adj[abs(i - j)] for j in range(lag)] for i in range(lag)])
        assert rows[lag - 1]["pacf"] == pytest.approx(np.linalg.solve(toeplitz, adj[1:lag + 1])[-1])
    q = s.ljung_box(grid, "value", 8).first()
    assert q["statistic"] == pytest.approx(120 * 122 * (r[1:] ** 2 / (120 - np.arange(1, 9))).sum())
    band = 1.959963984540054 * math.sqrt((1 + 2 * (r[1:3] ** 2).sum()) / 120)
    assert rows[2]["acf_high"] - rows[2]["acf"] == pytest.approx(band)


def test_stationarity_verdicts(spark):
    rng = np.random.default_rng(8)
    ar = np.zeros(400)
    for i in range(1, 400):
        ar[i] = 0.7 * ar[i - 1] + rng.normal()
    rows = [("ar", START + dt.timedelta(days=i), float(v)) for i, v in enumerate(ar)]
    rows += [("walk", START + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.normal(size=300).cumsum())]
    df = spark.createDataFrame(rows, "key string, date timestamp_ntz, value double")
    grid = s.regular_grid(df, "date", "value", "D", by=["key"])
    got = {r["key"]: r for r in s.stationarity_test(grid, "value", by=["key"]).collect()}
    assert got["ar"]["rejects_unit_root"] and got["ar"]["differences"] == 0
    assert not got["walk"]["rejects_unit_root"] and got["walk"]["differences"] == 1
    fit = s.forecast(grid.where("key = 'ar'"), "value", "D", 5, (1, 0, 0), by=["key"]).collect()
    assert fit[0]["coefficients"][1] == pytest.approx(0.7, abs=0.1)
    # forecasts of an AR(1) decay toward the mean, and intervals widen
    wide = [r["high"] - r["low"] for r in sorted(fit, key=lambda r: r["step"])]
    assert all(b > a for a, b in zip(wide, wide[1:]))


def test_adf_statistic_is_the_t_of_the_level(spark):
    y = np.random.default_rng(6).normal(size=80).cumsum()
    got = k.adf(y, "c")
    lags, d = got["lags_used"], np.diff(y)
    x = np.column_stack([y[lags:-1], np.ones(d.size - lags), *[d[lags - i: d.size - i] for i in range(1, lags + 1)]])
    b, *_ = np.linalg.lstsq(x, d[lags:], rcond=None)
    e = d[lags:] - x @ b
    se = math.sqrt(e @ e / (x.shape[0] - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    assert got["statistic"] == pytest.approx(b[0] / se)
    # the published 5 % point of the limiting distribution has p = 0.05
    assert k.mackinnon_p(-2.86154, "c") == pytest.approx(0.05, abs=0.001)
    assert k.mackinnon_p(-3.41049, "ct") == pytest.approx(0.05, abs=0.001)


def test_granger_finds_the_leader(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=250)
    y = np.r_[0.0, 0.8 * x[:-1]] + rng.normal(size=250)
    rows = [(START + dt.timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(y, x))]
    grid = s.regular_grid(spark.createDataFrame(rows, "date timestamp_ntz, y double, x double"), "date", ["y", "x"], "D")
    got = {r["lag"]: r for r in s.granger_causality(grid, "y", "x").collect()}
    assert got[1]["p_adjusted"] < 1e-10 and got[1]["summed_coefficient"] == pytest.approx(0.8, abs=0.2)
    back = s.granger_causality(grid, "x", "y").collect()
    assert min(r["p_adjusted"] for r in back) > 0.01
    with pytest.raises(Refusal):
        s.granger_causality(grid, "y", "y")


def test_forecast_of_a_line_and_a_season(spark):
    line = s.regular_grid(daily(spark, [2.0 * i + 1 for i in range(40)]), "date", "value", "D")
    rows = sorted(s.forecast(line, "value", "D", 3, (0, 2, 0)).collect(), key=lambda r: r["step"])
    assert [r["forecast"] for r in rows] == pytest.approx([81.0, 83.0, 85.0])
    assert rows[0]["period"] == dt.date(2020, 2, 10)
    week = s.regular_grid(daily(spark, [float(i % 7) for i in range(42)]), "date", "value", "D")
    rows = sorted(s.forecast(week, "value", "D", 7, (0, 0, 0), (0, 1, 0), 7).collect(), key=lambda r: r["step"])
    assert [r["forecast"] for r in rows] == pytest.approx([float(i) for i in range(7)])


def fleet(spark, series):
    rows = [(key, at, float(i * i % 17)) for key, days in series.items() for i, at in enumerate(days)]
    return spark.createDataFrame(rows, "key string, date timestamp_ntz, value double")


def test_fleet_of_mixed_lengths(spark):
    long, short = ([START + dt.timedelta(days=i) for i in range(n)] for n in (400, 14))
    both = s.regular_grid(fleet(spark, {"long": long, "short": short}), "date", "value", "D", by=["key"])
    got = {(r["key"], r["lag"]): r for r in s.autocorrelation(both, "value", by=["key"]).collect()}
    assert {k: sum(key == k for key, _ in got) for k in ("long", "short")} == {"long": 26, "short": 3}
    alone = s.regular_grid(fleet(spark, {"long": long}), "date", "value", "D", by=["key"])
    for r in s.autocorrelation(alone, "value", by=["key"]).collect():
        assert got["long", r["lag"]]["acf"] == pytest.approx(r["acf"])
        assert got["long", r["lag"]]["pacf"] == pytest.approx(r["pacf"])


def test_fleet_frequency(spark):
    staggered = {f"s{d}": [dt.datetime(2015 + m // 12, m % 12 + 1, d) for m in range(36)] for d in (1, 5, 9, 20)}
    grid = s.regular_grid(fleet(spark, staggered), "date", "value", by=["key"])
    assert grid.count() == 4 * 36
    assert {r["freq"] for r in grid.collect()} == {"ME"}


def test_fleet_of_mixed_frequencies(spark):
    """Every series as if it were alone; a single date makes a series too short, nothing more."""
    series = {
        "monthly": [dt.datetime(2015 + m // 12, m % 12 + 1, 5) for m in range(40)],
        "daily": [START + dt.timedelta(days=i) for i in range(30) if i != 11],
        "weekly": [START + dt.timedelta(days=7 * i) for i in range(20)],
        "yearly": [dt.datetime(1990 + y, 6, 1) for y in range(30)],
        "once": [START],
    }
    df = fleet(spark, series)
    grid = s.regular_grid(df, "date", "value", by=["key"])
    freqs = {"monthly": "ME", "daily": "D", "weekly": "W", "yearly": "YE"}
    got = {k: [tuple(r)[1:] for r in grid.where(F.col("key") == k).orderBy("idx").collect()] for k in freqs}
    report = {r["key"]: r for r in s.series_report(df, "date", "value", by=["key"]).collect()}
    assert report["once"]["refused"] == "fewer than 12 periods" and "once" not in {r["key"] for r in grid.collect()}
    for key, freq in freqs.items():
        alone = s.regular_grid(df.where(F.col("key") == key), "date", "value").orderBy("idx").collect()
        assert got[key] == [(*r, freq) for r in alone]
        assert (report[key]["freq"], report[key]["n_periods"], report[key]["refused"]) == (freq, len(alone), None)
    parts = s.decompose(df, "date", "value", by=["key"])  # weekly: under two cycles; yearly: no cycle
    assert {r["key"] for r in parts.collect()} == {"monthly", "daily"}
    for key in ("monthly", "daily"):
        alone = s.decompose(df.where(F.col("key") == key), "date", "value").orderBy("idx").collect()
        both = parts.where(F.col("key") == key).drop("key").orderBy("idx").collect()
        assert [r["residual"] for r in both] == [None if r["residual"] is None else pytest.approx(r["residual"]) for r in alone]
    ahead = s.forecast(grid, "value", None, 1, (0, 1, 0), by=["key"])
    assert {r["key"]: r["period"] for r in ahead.collect()} == {
        "monthly": dt.date(2018, 5, 31), "daily": dt.date(2020, 1, 31), "weekly": dt.date(2020, 5, 24), "yearly": dt.date(2020, 12, 31)}
    with pytest.raises(Refusal, match="no implied cycle"):
        s.decompose(df.where("key = 'yearly'"), "date", "value", by=["key"])
