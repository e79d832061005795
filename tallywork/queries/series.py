"""Time series: orders by month, and one daily series per event type."""

from pyspark.sql import functions as F

from tallywork.operators import series as s
from tallywork.queries.base import query, rounded, table

DATE = "strftime(period, '%Y-%m-%d') AS period"


def dated(df):
    return df.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def monthly(spark, d):
    return s.regular_grid(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "ME")


def daily(spark, d):
    return s.regular_grid(table(spark, d, "events"), "ts", "value", "D", by=["event_type"])


@query("infer_frequency",
       "WITH p AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS t FROM orders), g AS (SELECT date_diff('day', lag(t) OVER (ORDER BY t), t) AS gap FROM p) "
       "SELECT quantile_cont(gap, 0.5) AS median_gap_days, 'ME' AS freq FROM g")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return s.infer_frequency(df, "month")


@query("infer_frequency_by_key",
       "WITH p AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS t FROM events), g AS (SELECT event_type, date_diff('day', lag(t) OVER "
       "(PARTITION BY event_type ORDER BY t), t) AS gap FROM p) SELECT event_type, quantile_cont(gap, 0.5) AS median_gap_days, 'D' AS freq FROM g GROUP BY 1")
def _(spark, d):
    df = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return s.infer_frequency(df, "day", ["event_type"])


MONTHS = ("WITH c AS (SELECT last_day(o_orderdate) AS period, avg(o_totalprice) AS v FROM orders GROUP BY 1), "
          "g AS (SELECT period, row_number() OVER (ORDER BY period) - 1 AS idx, count(*) OVER () AS n, v FROM c) ")


@query("regular_grid", MONTHS + f"SELECT {DATE}, CAST(idx AS INTEGER) AS idx, n, round(v, 4) AS o_totalprice, FALSE AS was_interpolated FROM g")
def _(spark, d):
    return dated(rounded(monthly(spark, d), 4))


# a month with no usable row: the values of every sixth month are set to null
GAPS = "CASE WHEN (year(o_orderdate) * 12 + month(o_orderdate)) % 6 = 0 THEN NULL ELSE o_totalprice END"


@query("regular_grid_interpolated",
       f"WITH c AS (SELECT last_day(o_orderdate) AS period, avg({GAPS}) AS v FROM orders GROUP BY 1), "
       "b AS (SELECT min(period) FILTER (v IS NOT NULL) AS a, max(period) FILTER (v IS NOT NULL) AS z FROM c), "
       "k AS (SELECT period, v, last_value(v IGNORE NULLS) OVER (ORDER BY period) AS lo, last_value(CASE WHEN v IS NOT NULL THEN period END IGNORE NULLS) OVER (ORDER BY period) AS t0, "
       "first_value(v IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi, "
       "first_value(CASE WHEN v IS NOT NULL THEN period END IGNORE NULLS) OVER (ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 "
       "FROM c, b WHERE period BETWEEN a AND z) "
       f"SELECT {DATE}, round(coalesce(v, lo + (hi - lo) * date_diff('day', t0, period) / date_diff('day', t0, t1)), 4) AS value, v IS NULL AS was_interpolated FROM k")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("value", F.expr(GAPS))
    out = s.regular_grid(df, "o_orderdate", "value", "ME")
    return dated(rounded(out.select("period", "value", "was_interpolated"), 4))


@query("series_report",
       "SELECT event_type, count(DISTINCT CAST(ts AS DATE)) AS n_periods, count(*) AS n_used, count(*) - count(DISTINCT ts) AS n_duplicate_timestamps, "
       "'D' AS freq FROM events GROUP BY 1")
def _(spark, d):
    out = s.series_report(table(spark, d, "events"), "ts", "value", "D", by=["event_type"])
    return out.select("event_type", "n_periods", "n_used", "n_duplicate_timestamps", "freq")


# every event type by day, and all orders by month, as one fleet whose series find their own frequency
FLEET = ("WITH r AS (SELECT event_type AS series, 'D' AS freq, CAST(ts AS DATE) AS period, value AS v FROM events UNION ALL "
         "SELECT 'orders', 'ME', last_day(o_orderdate), o_totalprice FROM orders), "
         "c AS (SELECT series, freq, period, avg(v) AS v FROM r GROUP BY ALL), "
         "s AS (SELECT series, freq, min(period) AS a, max(period) AS z, count(*) AS cells FROM c GROUP BY ALL), "
         "p AS (SELECT series, freq, cells, unnest(CASE WHEN freq = 'D' THEN generate_series(a, z, INTERVAL 1 DAY) "
         "ELSE [CAST(last_day(x) AS TIMESTAMP) FOR x IN generate_series(date_trunc('month', a), z, INTERVAL 1 MONTH)] END)::DATE AS period FROM s), "
         "g AS (SELECT series, freq, period, v, cells, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY series) AS n, "
         "last_value(v IGNORE NULLS) OVER w AS lo, last_value(CASE WHEN v IS NOT NULL THEN period END IGNORE NULLS) OVER w AS t0, "
         "first_value(v IGNORE NULLS) OVER f AS hi, first_value(CASE WHEN v IS NOT NULL THEN period END IGNORE NULLS) OVER f AS t1 "
         "FROM p LEFT JOIN c USING (series, freq, period) WINDOW w AS (PARTITION BY series ORDER BY period), "
         "f AS (PARTITION BY series ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) ")


@query("regular_grid_mixed_fleet", FLEET +
       f"SELECT series, {DATE}, CAST(idx AS INTEGER) AS idx, n, freq, v IS NULL AS was_interpolated, "
       "round(coalesce(v, lo + (hi - lo) * date_diff('day', t0, period) / date_diff('day', t0, t1)), 6) AS value "
       "FROM g WHERE n >= 12 AND n - cells <= 0.2 * n")
def _(spark, d):
    events = table(spark, d, "events").selectExpr("event_type AS series", "to_date(ts) AS at", "value")
    orders = table(spark, d, "orders").selectExpr(
        "'orders' AS series", "to_date(date_trunc('month', o_orderdate)) AS at", "o_totalprice AS value")
    return dated(rounded(s.regular_grid(events.unionByName(orders), "at", "value", by=["series"]), 6))


# lines dealt to the days of 82 years by their order, and one short series beside it
LONG_DAY = "CAST((2 * l_orderkey + l_linenumber % 2) % 30000 AS INTEGER)"


@query("regular_grid_long_series",
       f"WITH r AS (SELECT 'all' AS series, {LONG_DAY} AS d, l_quantity AS v FROM lineitem UNION ALL "
       f"SELECT 'first month', {LONG_DAY}, l_quantity FROM lineitem WHERE {LONG_DAY} < 30), "
       "c AS (SELECT series, d, avg(CAST(v AS DOUBLE)) AS v FROM r GROUP BY ALL), "
       "s AS (SELECT series, min(d) AS a, max(d) AS z, count(*) AS cells FROM c GROUP BY 1), "
       "p AS (SELECT series, a, z, cells, CAST(unnest(generate_series(a, z)) AS INTEGER) AS d FROM s), "
       "k AS (SELECT series, d, v, a, z - a + 1 AS n, cells, last_value(v IGNORE NULLS) OVER w AS lo, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER w AS t0, "
       "last_value(v IGNORE NULLS) OVER f AS hi, last_value(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER f AS t1 FROM p LEFT JOIN c USING (series, d) "
       "WINDOW w AS (PARTITION BY series ORDER BY d), f AS (PARTITION BY series ORDER BY d DESC)) "
       "SELECT series, strftime(DATE '1900-01-01' + d, '%Y-%m-%d') AS period, d - a AS idx, CAST(n AS BIGINT) AS n, v IS NULL AS was_interpolated, "
       "round(coalesce(v, lo + (hi - lo) * (d - t0) / (t1 - t0)), 6) AS value FROM k WHERE n >= 12 AND n - cells <= 0.2 * n")
def _(spark, d):
    lines = table(spark, d, "lineitem").selectExpr(f"{LONG_DAY} AS d", "CAST(l_quantity AS DOUBLE) AS value")
    series = lines.selectExpr("d", "value", "explode(CASE WHEN d < 30 THEN array('all', 'first month') ELSE array('all') END) AS series")
    series = series.withColumn("at", F.expr("date_add(DATE'1900-01-01', d)"))
    return dated(rounded(s.regular_grid(series, "at", "value", "D", by=["series"]), 6))


CLASSIC = MONTHS + (
    ", t AS (SELECT *, CASE WHEN idx >= 6 AND idx < n - 6 THEN (sum(v) OVER (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) "
    "- (lag(v, 6) OVER (ORDER BY idx) + lead(v, 6) OVER (ORDER BY idx)) / 2) / 12 END AS trend FROM g), "
    "p AS (SELECT idx % 12 AS phase, avg(v - trend) AS sm FROM t GROUP BY 1), m AS (SELECT avg(sm) AS sc FROM p), "
    "x AS (SELECT period, idx, n, v, trend, sm - sc AS seasonal, v - trend - (sm - sc) AS residual FROM t JOIN p ON phase = idx % 12, m) ")


@query("decompose_classical", CLASSIC +
       f"SELECT {DATE}, round(v, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal, round(residual, 6) AS residual FROM x")
def _(spark, d):
    out = s.decompose_classical(monthly(spark, d), "o_totalprice", 12)
    return dated(rounded(out.drop("idx", "n"), 6))


@query("component_strength", CLASSIC +
       "SELECT round(greatest(0, 1 - var_samp(residual) / var_samp(residual + trend)), 5) AS trend_strength, "
       "round(greatest(0, 1 - var_samp(residual) / var_samp(residual + seasonal)), 5) AS seasonal_strength, "
       "round(max(seasonal) - min(seasonal), 3) AS peak_to_trough FROM x")
def _(spark, d):
    out = s.component_strength(s.decompose_classical(monthly(spark, d), "o_totalprice", 12))
    return rounded(out, 5, peak_to_trough=3)


@query("trend_slope", CLASSIC +
       "SELECT count(trend) AS n, round(regr_slope(trend, idx), 4) AS slope, round(sqrt((regr_syy(trend, idx) - power(regr_sxy(trend, idx), 2) / regr_sxx(trend, idx)) "
       "/ regr_sxx(trend, idx) / (count(trend) - 2)), 5) AS stderr FROM x WHERE trend IS NOT NULL")
def _(spark, d):
    out = s.trend_slope(s.decompose_classical(monthly(spark, d), "o_totalprice", 12))
    return rounded(out.select("n", "slope", "stderr"), 4, stderr=5)


@query("decompose_stl")
def _(spark, d):
    return dated(rounded(s.decompose(table(spark, d, "events"), "ts", "value", "D", by=["event_type"]), 4))


DAYS = ("WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), "
        "g AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS n, "
        "v - avg(v) OVER (PARTITION BY event_type) AS x FROM c), "
        "r AS (SELECT a.event_type, CAST(k AS INTEGER) AS lag, any_value(a.n) AS n, sum(a.x * b.x) / any_value(z) AS acf FROM g a, range(1, 8) t(k), g b, "
        "(SELECT event_type AS e, sum(x * x) AS z FROM g GROUP BY 1) WHERE a.event_type = b.event_type AND b.idx = a.idx - k AND e = a.event_type GROUP BY 1, 2) ")


@query("autocorrelation", DAYS + "SELECT event_type, lag, n, round(acf, 6) AS acf FROM r")
def _(spark, d):
    return rounded(s.autocorrelation(daily(spark, d), "value", 7, ["event_type"]).select("event_type", "lag", "n", "acf"))


@query("partial_autocorrelation")
def _(spark, d):
    return rounded(s.autocorrelation(monthly(spark, d), "o_totalprice"))


@query("ljung_box", DAYS + "SELECT event_type, any_value(n) AS n, CAST(5 AS BIGINT) AS lags, round(any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)), 5) AS statistic "
       "FROM r WHERE lag <= 5 GROUP BY 1")
def _(spark, d):
    return rounded(s.ljung_box(daily(spark, d), "value", 5, by=["event_type"]).select("event_type", "n", "lags", "statistic"), 5)


@query("adf_test")
def _(spark, d):
    return rounded(s.adf_test(monthly(spark, d), "o_totalprice"), 5)


@query("kpss_test")
def _(spark, d):
    return rounded(s.kpss_test(daily(spark, d), "value", "ct", ["event_type"]), 5)


@query("stationarity_test")
def _(spark, d):
    return rounded(s.stationarity_test(daily(spark, d), "value", by=["event_type"]), 5)


@query("difference_to_stationarity")
def _(spark, d):
    out = s.difference_to_stationarity(monthly(spark, d), ["o_totalprice"])
    return dated(rounded(out, 3))


@query("granger_causality")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("open", F.expr("CAST(o_orderstatus = 'O' AS DOUBLE)"))
    grid = s.regular_grid(df, "o_orderdate", ["o_totalprice", "open"], "ME")
    return rounded(s.granger_causality(grid, "o_totalprice", "open"), 5)


@query("forecast")
def _(spark, d):
    out = s.forecast(daily(spark, d), "value", "D", 7, order=(1, 0, 1), by=["event_type"])
    return dated(rounded(out.drop("coefficients"), 4))


@query("forecast_seasonal")
def _(spark, d):
    out = s.forecast(monthly(spark, d), "o_totalprice", "ME", 12, order=(0, 1, 1), seasonal=(0, 1, 1), season=12)
    return dated(rounded(out.drop("coefficients"), 2))
