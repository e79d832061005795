"""Grouped summaries, counts, cross tables, bins, resampling."""

from pyspark.sql import functions as F

from tallywork.operators import tables as t
from tallywork.queries.base import messy, query, rounded, table, with_messy


@query("groupby_sum",
       "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS l_extendedprice_sum FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(t.groupby_aggregate(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", "sum"), 2)


AGG_SQL = {"mean": "avg({c})", "median": "quantile_cont({c}, 0.5)", "min": "min({c})", "max": "max({c})",
           "std": "stddev_samp({c})", "var": "var_samp({c})", "count": "count({c})",
           "nunique": "count(DISTINCT {c})"}
for _agg, _sql in AGG_SQL.items():
    _c = "price"
    _expr = _sql.format(c=_c)
    if _agg not in ("count", "nunique"):
        _expr = f"round({_expr}, {-4 if _agg == 'var' else 4})"
    query(f"groupby_{_agg}", with_messy(
        f"SELECT status, Finished, {_expr} AS price_{_agg} FROM messy GROUP BY 1, 2"))(
        lambda spark, d, agg=_agg: rounded(
            t.groupby_aggregate(messy(spark, d), ["status", "Finished"], "price", agg), -4 if agg == "var" else 4))


@query("describe",
       "SELECT s AS statistic, round(CASE s WHEN 'count' THEN count(q) WHEN 'mean' THEN avg(q) WHEN 'std' THEN stddev_samp(q) "
       "WHEN 'min' THEN min(q) WHEN '25%' THEN quantile_cont(q, 0.25) WHEN '50%' THEN quantile_cont(q, 0.5) "
       "WHEN '75%' THEN quantile_cont(q, 0.75) ELSE max(q) END, 4) AS l_quantity, "
       "round(CASE s WHEN 'count' THEN count(p) WHEN 'mean' THEN avg(p) WHEN 'std' THEN stddev_samp(p) "
       "WHEN 'min' THEN min(p) WHEN '25%' THEN quantile_cont(p, 0.25) WHEN '50%' THEN quantile_cont(p, 0.5) "
       "WHEN '75%' THEN quantile_cont(p, 0.75) ELSE max(p) END, 4) AS l_extendedprice FROM "
       "(SELECT l_quantity AS q, l_extendedprice AS p FROM lineitem), "
       "(SELECT unnest(['count','mean','std','min','25%','50%','75%','max']) AS s) GROUP BY s")
def _(spark, d):
    return rounded(t.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 4)


@query("value_counts",
       with_messy("SELECT amount, count(*) AS count FROM messy WHERE amount IS NOT NULL GROUP BY 1 "
                  "ORDER BY count(*) DESC, amount LIMIT 20"))
def _(spark, d):
    return t.value_counts(messy(spark, d), "amount")


@query("value_counts_normalized",
       "SELECT event_type, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS proportion "
       "FROM events GROUP BY 1")
def _(spark, d):
    return rounded(t.value_counts(table(spark, d, "events"), "event_type", normalize=True))


@query("crosstab",
       "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O "
       "FROM lineitem GROUP BY 1")
def _(spark, d):
    return t.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("crosstab_normalized",
       "SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS F, "
       "round(count(*) FILTER (o_orderstatus = 'O') / CAST(count(*) AS DOUBLE), 6) AS O, "
       "round(count(*) FILTER (o_orderstatus = 'P') / CAST(count(*) AS DOUBLE), 6) AS P FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(t.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", normalize=True))


@query("histogram",
       "WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), c AS (SELECT "
       "CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, count(*) AS n "
       "FROM orders, s GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 10), 4) AS lower, "
       "round(lo + (i + 1) * ((hi - lo) / 10), 4) AS upper, coalesce(n, 0) AS count FROM s, range(10) r(i) "
       "LEFT JOIN c ON bin = i")
def _(spark, d):
    return rounded(t.histogram(table(spark, d, "orders"), "o_totalprice"), 4)


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return t.top_n(table(spark, d, "orders"), "o_orderkey", "o_totalprice")


@query("pivot",
       "SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS F, "
       "round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS O, "
       "round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS P FROM orders GROUP BY 1")
def _(spark, d):
    return rounded(t.pivot(
        table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", "mean"), 4)


@query("pivot_median",
       "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5) FILTER (l_linestatus = 'F'), 4) AS F, "
       "round(quantile_cont(l_extendedprice, 0.5) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")
def _(spark, d):
    return rounded(t.pivot(
        table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_extendedprice", "median"), 4)


ENDS = {
    "D": ("CAST(o_orderdate AS DATE)", "INTERVAL 1 DAY", "d"),
    "W": ("CAST(date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS DATE)", "INTERVAL 7 DAY", "d"),
    "ME": ("last_day(o_orderdate)", "INTERVAL 1 MONTH", "last_day(d)"),
    "QE": ("CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
           "INTERVAL 3 MONTH", "last_day(d)"),
    "YE": ("CAST(date_trunc('year', o_orderdate) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE)",
           "INTERVAL 12 MONTH", "last_day(d)"),
}
RESAMPLE_AGG = {"D": "sum", "W": "count", "ME": "mean", "QE": "median", "YE": "max"}
for _f, (_end, _step, _shown) in ENDS.items():
    _agg = RESAMPLE_AGG[_f]
    _expr = {"sum": "sum({c})", **AGG_SQL}[_agg].format(c="o_totalprice")
    _val = f"coalesce({_expr}, 0)" if _agg in ("sum", "count") else _expr
    _val = _val if _agg == "count" else f"round({_val}, {2 if _agg == 'sum' else 5})"
    _first = "m" if _shown == "d" else "date_trunc('month', m)"
    query(f"resample_{_f.lower()}",
          f"WITH e AS (SELECT {_end} AS p, o_totalprice FROM orders), s AS (SELECT min(p) AS m, max(p) AS x FROM e), "
          f"c AS (SELECT CAST(unnest(generate_series(CAST({_first} AS TIMESTAMP), CAST(x AS TIMESTAMP), {_step})) AS DATE) AS d FROM s) "
          f"SELECT strftime(k, '%Y-%m-%d') AS o_orderdate, {_val} AS o_totalprice_{_agg} FROM "
          f"(SELECT CAST({_shown} AS DATE) AS k FROM c) LEFT JOIN e ON p = k GROUP BY k")(
        lambda spark, d, f=_f, agg=_agg: rounded(
            t.resample(table(spark, d, "orders"), "o_orderdate", "o_totalprice", f, agg), 2 if agg == "sum" else 5)
        .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")))
