"""Correlations, fitted lines, group comparison."""

from tallywork.operators import bivariate as b
from tallywork.queries.base import query, rounded, table

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql(source, cols, value="corr({a}, {b})"):
    parts = [
        f"SELECT '{a}' AS column1, '{c}' AS column2, count(*) AS n, round({value.format(a=a, b=c)}, 6) AS r FROM {source}"
        for i, a in enumerate(cols) for c in cols[i + 1:]
    ]
    return " UNION ALL ".join(parts)


@query("correlation_pearson", _pair_sql("lineitem", COLS))
def _(spark, d):
    return rounded(b.correlation_pairs(table(spark, d, "lineitem"), COLS).drop("p_value"))


@query("correlation_matrix", "SELECT 'l_quantity' AS \"column\", 1.0::DOUBLE AS l_quantity, "
       "round(corr(l_quantity, l_extendedprice), 4) AS l_extendedprice FROM lineitem UNION ALL "
       "SELECT 'l_extendedprice', round(corr(l_quantity, l_extendedprice), 4), 1.0::DOUBLE FROM lineitem")
def _(spark, d):
    return b.correlation_matrix(table(spark, d, "lineitem"), COLS[:2])


RANKS = ("WITH k AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in COLS)
    + " FROM lineitem) ")


@query("correlation_spearman", RANKS + _pair_sql("k", COLS))
def _(spark, d):
    return rounded(b.correlation_pairs(table(spark, d, "lineitem"), COLS, "spearman").drop("p_value"))


PAIRS = ("WITH p AS (SELECT sum(sign(a.c_acctbal - b.c_acctbal) * sign(a.c_nationkey - b.c_nationkey)) AS s, "
         "count(*) FILTER (a.c_acctbal <> b.c_acctbal) AS nx, count(*) FILTER (a.c_nationkey <> b.c_nationkey) AS ny "
         "FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey) ")


@query("correlation_kendall", PAIRS +
       "SELECT 'c_acctbal' AS column1, 'c_nationkey' AS column2, (SELECT count(*) FROM customer) AS n, "
       "round(s / sqrt(CAST(nx AS DOUBLE) * ny), 8) AS r FROM p")
def _(spark, d):
    out = b.correlation_pairs(table(spark, d, "customer"), ["c_acctbal", "c_nationkey"], "kendall")
    return rounded(out.drop("p_value"), 8)


ORDER_PAIRS = (
    "WITH p AS (SELECT sum(sign(a.o_totalprice - b.o_totalprice) * sign(a.o_custkey - b.o_custkey)) AS s, "
    "count(*) FILTER (a.o_totalprice <> b.o_totalprice) AS nx, count(*) FILTER (a.o_custkey <> b.o_custkey) AS ny "
    "FROM orders a JOIN orders b ON a.o_orderkey < b.o_orderkey) "
    "SELECT 'o_totalprice' AS column1, 'o_custkey' AS column2, (SELECT count(*) FROM orders) AS n, "
    "round(s / sqrt(CAST(nx AS DOUBLE) * ny), 8) AS r FROM p")


@query("correlation_kendall_orders", ORDER_PAIRS)
def _(spark, d):
    out = b.correlation_pairs(table(spark, d, "orders"), ["o_totalprice", "o_custkey"], "kendall")
    return rounded(out.drop("p_value"), 8)


@query("scatter_with_fit",
       "WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS g FROM lineitem UNION ALL "
       "SELECT l_quantity, l_extendedprice, '(all)' FROM lineitem) SELECT g AS \"group\", count(*) AS n, "
       "round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept, round(corr(x, y), 6) AS r, "
       "round(power(corr(x, y), 2), 6) AS r_squared, "
       "round(sqrt((1 - power(corr(x, y), 2)) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)), 4) AS stderr "
       "FROM r GROUP BY g")
def _(spark, d):
    fit = b.scatter_with_fit(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return rounded(fit.drop("p_value"), 6, slope=4, intercept=4, stderr=4)


@query("scatter_points")
def _(spark, d):
    return b.scatter_points(table(spark, d, "orders"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("group_comparison",
       "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, "
       "round(quantile_cont(o_totalprice, 0.5), 4) AS median FROM orders GROUP BY 1")
def _(spark, d):
    out = b.group_comparison(table(spark, d, "orders"), "o_totalprice", "o_orderstatus")
    return rounded(out.drop("ci95_low", "ci95_high"), 4)


ONE_WAY = """
WITH r AS (SELECT {g} AS g, {x} AS x FROM {t}), m AS (SELECT g, count(*) AS n, avg(x) AS mean, var_samp(x) AS v FROM r GROUP BY g
  HAVING count(*) > 1),
a AS (SELECT sum(n * mean) / sum(n) AS gm FROM m),
s AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * power(mean - gm, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM m, a)
"""


@query("group_comparison_test", ONE_WAY.format(g="event_type", x="value", t="events") +
       "SELECT 'one_way_f' AS test, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS statistic, CAST(k - 1 AS DOUBLE) AS dof, "
       "CAST(n - k AS DOUBLE) AS dof_within, n FROM s")
def _(spark, d):
    out = b.group_comparison_test(table(spark, d, "events"), "value", "event_type")
    return rounded(out.drop("p_value", "n_groups_dropped"))
