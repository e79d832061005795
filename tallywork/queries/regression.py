"""Regression: closed forms in SQL for one regressor, rows-only for iterative fits."""

from pyspark.sql import functions as F

from tallywork.operators import gram as g
from tallywork.operators import regression as r
from tallywork.operators import segments as seg
from tallywork.queries.base import query, rounded, table

ONE = ("WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, "
       "avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, count(*) AS n FROM lineitem), "
       "e AS (SELECT l_orderkey, l_linenumber, l_quantity - mx AS xc, l_extendedprice - a - b * l_quantity AS e, "
       "1.0::DOUBLE / n + power(l_quantity - mx, 2) / sxx AS h FROM lineitem, f), "
       "s AS (SELECT sum(e * e) AS rss, sum(e * e) / (count(*) - 2) AS s2, count(*) AS n FROM e) ")


def lineitem(spark, d):
    return table(spark, d, "lineitem")


@query("ols_classical", ONE +
       "SELECT 'l_quantity' AS term, round(b, 4) AS coefficient, round(sqrt(s2 / sxx), 5) AS std_error, round(b / sqrt(s2 / sxx), 4) AS statistic "
       "FROM f, s UNION ALL SELECT '(Intercept)', round(a, 4), round(sqrt(s2 * (1.0::DOUBLE / s.n + mx * mx / sxx)), 5), "
       "round(a / sqrt(s2 * (1.0::DOUBLE / s.n + mx * mx / sxx)), 4) FROM f, s")
def _(spark, d):
    fit = r.ols(lineitem(spark, d), "l_extendedprice", ["l_quantity"], robust="none")
    return rounded(fit.coefficients.select("term", "coefficient", "std_error", "statistic"), 4, std_error=5)


for _hc, _w in (("HC0", "e * e"), ("HC1", "e * e * n / (n - 2)"), ("HC2", "e * e / (1 - h)"), ("HC3", "e * e / power(1 - h, 2)")):
    query(f"ols_{_hc.lower()}", ONE +
          f"SELECT 'l_quantity' AS term, round(any_value(b), 4) AS coefficient, round(sqrt(sum({_w} * xc * xc)) / any_value(sxx), 5) AS std_error "
          "FROM e, (SELECT b, sxx, n FROM f) f")(
        lambda spark, d, hc=_hc: rounded(
            r.ols(lineitem(spark, d), "l_extendedprice", ["l_quantity"], robust=hc).coefficients
            .where("term = 'l_quantity'").select("term", "coefficient", "std_error"), 4, std_error=5))


@query("ols_summary", ONE +
       ", t AS (SELECT sum(power(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem), 2)) AS tss FROM lineitem) "
       "SELECT n, CAST(0 AS BIGINT) AS n_excluded, round(1 - rss / tss, 6) AS r_squared, round(1 - rss / tss * (n - 1) / (n - 2), 6) AS adj_r_squared, "
       "round((tss - rss) / s2, 1) AS f_statistic, CAST(1 AS BIGINT) AS dof_model, n - 2 AS dof_resid, round(sqrt(s2), 3) AS rmse, "
       "round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 4, 3) AS aic, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * ln(n), 3) AS bic FROM s, t")
def _(spark, d):
    fit = r.ols(lineitem(spark, d), "l_extendedprice", ["l_quantity"], robust="none")
    out = fit.summary.select("n", "n_excluded", "r_squared", "adj_r_squared", "f_statistic", "dof_model", "dof_resid", "rmse", "aic", "bic")
    return rounded(out, 3, r_squared=6, adj_r_squared=6, f_statistic=1)


@query("ols_multiple")
def _(spark, d):
    fit = r.ols(lineitem(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"])
    return rounded(fit.coefficients, 4)


@query("design_matrix",
       "SELECT 'l_quantity' AS term, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem UNION ALL "
       "SELECT 'l_returnflag[N]', round(avg((l_returnflag = 'N')::INT), 6), round(stddev_samp((l_returnflag = 'N')::INT), 6) FROM lineitem UNION ALL "
       "SELECT 'l_returnflag[R]', round(avg((l_returnflag = 'R')::INT), 6), round(stddev_samp((l_returnflag = 'R')::INT), 6) FROM lineitem")
def _(spark, d):
    terms = g.design_matrix(lineitem(spark, d), "l_extendedprice", ["l_quantity", "l_returnflag"])
    rows = [(n, float(m), float(s)) for n, m, s in zip(terms.names, terms.means, terms.sds)]
    return rounded(spark.createDataFrame(rows, "term string, mean double, sd double"))


@query("vif",
       "WITH c AS (SELECT corr(l_quantity, l_discount) AS a, corr(l_quantity, l_tax) AS b, corr(l_discount, l_tax) AS c FROM lineitem), "
       "d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c) SELECT 'l_quantity' AS term, round((1 - c * c) / det, 7) AS vif, TRUE AS ok FROM d "
       "UNION ALL SELECT 'l_discount', round((1 - b * b) / det, 7), TRUE FROM d UNION ALL SELECT 'l_tax', round((1 - a * a) / det, 7), TRUE FROM d")
def _(spark, d):
    return rounded(r.vif(lineitem(spark, d), ["l_quantity", "l_discount", "l_tax"]), 7)


@query("breusch_pagan", ONE +
       "SELECT round(count(*) * power(corr(e * e, xc), 2), 3) AS statistic, CAST(1 AS BIGINT) AS dof FROM e")
def _(spark, d):
    out = r.breusch_pagan(lineitem(spark, d), "l_extendedprice", ["l_quantity"])
    return rounded(out.select("statistic", "dof"), 3)


@query("jarque_bera", ONE +
       ", m AS (SELECT avg(e) AS me FROM e), k AS (SELECT avg(power(e - me, 2)) AS m2, avg(power(e - me, 3)) AS m3, avg(power(e - me, 4)) AS m4, "
       "count(*) AS n FROM e, m), j AS (SELECT n / 6.0::DOUBLE * (power(m3, 2) / power(m2, 3) + power(m4 / (m2 * m2) - 3, 2) / 4) AS jb FROM k) "
       "SELECT round(jb, 3) AS statistic, round(exp(-jb / 2), 6) AS p_value FROM j")
def _(spark, d):
    out = r.jarque_bera(lineitem(spark, d), "l_extendedprice", ["l_quantity"])
    return rounded(out.select("statistic", "p_value"), 3, p_value=6)


@query("cooks_distance", ONE +
       ", c AS (SELECT e * e / (2 * s2) * h / power(1 - h, 2) AS d, n FROM e, s) SELECT round(count(*) FILTER (d > 4.0::DOUBLE / n) / CAST(any_value(n) AS DOUBLE), 6) "
       "AS influential_share, round(max(d), 8) AS max_cook FROM c")
def _(spark, d):
    out = r.cooks_distance(lineitem(spark, d), "l_extendedprice", ["l_quantity"])
    return rounded(out.drop("passed"), 6, max_cook=8)


@query("durbin_watson",
       "WITH f AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders), "
       "e AS (SELECT o_orderkey, o_totalprice - a - b * o_custkey AS e FROM orders, f), l AS (SELECT e, lag(e) OVER (ORDER BY o_orderkey) AS p FROM e) "
       "SELECT round(sum(power(e - p, 2)) / sum(e * e), 8) AS statistic, sum(power(e - p, 2)) / sum(e * e) BETWEEN 1.5 AND 2.5 AS passed FROM l")
def _(spark, d):
    return rounded(r.durbin_watson(table(spark, d, "orders"), "o_totalprice", ["o_custkey"], "o_orderkey"), 8)


# one two-level regressor has a closed form: cell log-odds and their standard errors
ODDS = ("WITH k AS (SELECT CAST(count(*) FILTER (o_orderstatus = 'F' AND g = 'b') AS DOUBLE) AS a, count(*) FILTER (o_orderstatus <> 'F' AND g = 'b') AS b, "
        "CAST(count(*) FILTER (o_orderstatus = 'F' AND g = 'a') AS DOUBLE) AS c, count(*) FILTER (o_orderstatus <> 'F' AND g = 'a') AS d "
        "FROM (SELECT o_orderstatus, CASE WHEN o_orderpriority < '3' THEN 'a' ELSE 'b' END AS g FROM orders)) ")


def finals(spark, d):
    return table(spark, d, "orders").selectExpr(
        "CASE WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS final",
        "CASE WHEN o_orderpriority < '3' THEN 'a' ELSE 'b' END AS g", "o_totalprice", "o_custkey")


@query("logit", ODDS +
       "SELECT 'g[b]' AS term, round(ln(a * d / (b * c)), 6) AS coefficient, round(sqrt(1 / a + 1.0::DOUBLE / b + 1 / c + 1.0::DOUBLE / d), 6) AS std_error, "
       "round(a * d / (b * c), 6) AS odds_ratio FROM k UNION ALL SELECT '(Intercept)', round(ln(c / d), 6), round(sqrt(1 / c + 1.0::DOUBLE / d), 6), round(c / d, 6) FROM k")
def _(spark, d):
    fit = r.logit(finals(spark, d), "final", ["g"], "yes")
    return rounded(fit.coefficients.select("term", "coefficient", "std_error", "odds_ratio"))


@query("logit_multiple")
def _(spark, d):
    return rounded(r.logit(finals(spark, d), "final", ["g", "o_totalprice", "o_custkey"], "yes", "HC0").coefficients, 8)


@query("logit_summary",
       "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS successes, round(avg((o_orderstatus = 'F')::INT), 6) AS base_rate, "
       "round(count(*) * (avg((o_orderstatus = 'F')::INT) * ln(avg((o_orderstatus = 'F')::INT)) + avg((o_orderstatus <> 'F')::INT) * ln(avg((o_orderstatus <> 'F')::INT))), 4) "
       "AS null_log_likelihood FROM orders")
def _(spark, d):
    out = r.logit(finals(spark, d), "final", ["g"], "yes").summary
    return rounded(out.select("n", "successes", "base_rate", "null_log_likelihood"), 4, base_rate=6)


@query("events_per_predictor",
       "SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS successes, round(least(count(*) FILTER (o_orderstatus = 'F'), "
       "count(*) FILTER (o_orderstatus <> 'F')) / 2.0::DOUBLE, 4) AS events_per_predictor, TRUE AS passed FROM orders")
def _(spark, d):
    return rounded(r.events_per_predictor(finals(spark, d), "final", ["g", "o_totalprice"], "yes"), 4)


def lines_per_order(spark, d):
    """Number of lines per order with the order's status and value."""
    lines = lineitem(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
    return table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr(
        "lines", "quantity", "o_totalprice / 1000 AS thousands",
        "CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS state")


COUNTS = ("WITH k AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), m AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END "
          "AS state, CAST(sum(lines) AS DOUBLE) AS y, count(*) AS n, sum(quantity) AS q FROM orders JOIN k ON o_orderkey = l_orderkey GROUP BY 1), "
          "p AS (SELECT a.y AS y0, a.n AS n0, a.q AS q0, b.y AS y1, b.n AS n1, b.q AS q1 FROM m a, m b WHERE a.state = 'final' AND b.state = 'open') ")


@query("count_model_poisson", COUNTS +
       "SELECT 'state[open]' AS term, round(ln((y1 / n1) / (y0 / n0)), 6) AS coefficient, round(sqrt(1 / y1 + 1 / y0), 6) AS std_error FROM p UNION ALL "
       "SELECT '(Intercept)', round(ln(y0 / n0), 6), round(sqrt(1 / y0), 6) FROM p")
def _(spark, d):
    fit = r.count_model(lines_per_order(spark, d), "lines", ["state"])
    return rounded(fit.coefficients.select("term", "coefficient", "std_error"))


@query("count_model_exposure", COUNTS +
       "SELECT 'state[open]' AS term, round((y1 / q1) / (y0 / q0), 6) AS irr FROM p UNION ALL SELECT '(Intercept)', round(y0 / q0, 6) FROM p")
def _(spark, d):
    fit = r.count_model(lines_per_order(spark, d), "lines", ["state"], exposure="quantity")
    return rounded(fit.coefficients.select("term", "irr"))


@query("dispersion_check",
       "WITH k AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), r AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 'final' ELSE 'open' END AS state, lines "
       "FROM orders JOIN k ON o_orderkey = l_orderkey), m AS (SELECT state, avg(lines) AS mu FROM r GROUP BY 1) SELECT round(sum(power(lines - mu, 2) / mu), 3) AS pearson_chi2, "
       "count(*) - 2 AS dof_resid, round(sum(power(lines - mu, 2) / mu) / (count(*) - 2), 6) AS dispersion FROM r JOIN m USING (state)")
def _(spark, d):
    out = r.dispersion_check(lines_per_order(spark, d), "lines", ["state"])
    return rounded(out.drop("p_value", "passed"), 6, pearson_chi2=3)


@query("count_model_negative_binomial")
def _(spark, d):
    # lines per customer vary more than a Poisson count
    lines = lineitem(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    per = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(
        F.sum("lines").alias("lines"))
    df = table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "coalesce(lines, 0) AS lines", "c_mktsegment", "c_acctbal / 1000 AS balance")
    return rounded(r.count_model(df, "lines", ["c_mktsegment", "balance"], "negative_binomial").coefficients, 5)


def lines_per_customer(spark, d):
    """Lines of all orders of a customer, none included: they vary more than a Poisson count."""
    lines = lineitem(spark, d).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        "o_custkey").agg(F.count("*").alias("lines"))
    return table(spark, d, "customer").join(lines, F.col("c_custkey") == F.col("o_custkey"), "left").selectExpr(
        "coalesce(lines, 0) AS lines", "CASE WHEN c_mktsegment < 'C' THEN 'early' ELSE 'late' END AS part",
        "c_nationkey % 5 AS area")


# with one two-level regressor the means are the estimates, and the dispersion solves one equation in r = 1 / alpha:
# sum over j of (customers above j) / (r + j) = sum over levels of n * ln(1 + mean / r), found by bisection on ln r
PER_CUSTOMER = ("WITH RECURSIVE k AS (SELECT o_custkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1), "
                "c AS (SELECT coalesce(lines, 0) AS lines, CASE WHEN c_mktsegment < 'C' THEN 'early' ELSE 'late' END AS part, c_nationkey % 5 AS area "
                "FROM customer LEFT JOIN k ON c_custkey = o_custkey), ")
DISPERSION = ("m AS (SELECT part, CAST(count(*) AS DOUBLE) AS n, avg(lines) AS mu FROM c GROUP BY 1), "
              "a AS (SELECT j, (SELECT count(*) FROM c WHERE lines > j)::DOUBLE AS above FROM generate_series(0, (SELECT max(lines) - 1 FROM c)) s(j)), "
              "b AS (SELECT 0 AS step, -12.0::DOUBLE AS lo, 12.0::DOUBLE AS hi UNION ALL SELECT step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END "
              "FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, (SELECT sum(above / (exp((lo + hi) / 2) + j)) FROM a) > (SELECT sum(n * ln(1 + mu / exp((lo + hi) / 2))) FROM m) AS up "
              "FROM b WHERE step < 60) t), r AS (SELECT exp(-(lo + hi) / 2) AS alpha FROM b WHERE step = 60), "
              "p AS (SELECT e.mu AS m0, e.n AS n0, l.mu AS m1, l.n AS n1, alpha FROM m e, m l, r WHERE e.part = 'early' AND l.part = 'late') ")


@query("count_model_dispersion", PER_CUSTOMER + DISPERSION +
       "SELECT 'part[late]' AS term, round(ln(m1 / m0), 6) AS coefficient, round(sqrt((1 + alpha * m0) / (n0 * m0) + (1 + alpha * m1) / (n1 * m1)), 6) AS std_error, "
       "round(alpha, 6) AS alpha FROM p UNION ALL SELECT '(Intercept)', round(ln(m0), 6), round(sqrt((1 + alpha * m0) / (n0 * m0)), 6), round(alpha, 6) FROM p")
def _(spark, d):
    fit = r.count_model(lines_per_customer(spark, d), "lines", ["part"], "negative_binomial")
    return rounded(fit.coefficients.select("term", "coefficient", "std_error").crossJoin(fit.summary.select("alpha")))


@query("count_model_segments", PER_CUSTOMER +
       "g AS (SELECT area, part, CAST(sum(lines) AS DOUBLE) AS y, count(*) AS n FROM c GROUP BY 1, 2) "
       "SELECT e.area, 'part[late]' AS term, round(ln((l.y / l.n) / (e.y / e.n)), 6) AS coefficient, round(sqrt(1 / l.y + 1 / e.y), 6) AS std_error "
       "FROM g e JOIN g l USING (area) WHERE e.part = 'early' AND l.part = 'late' UNION ALL "
       "SELECT area, '(Intercept)', round(ln(y / n), 6), round(sqrt(1 / y), 6) FROM g WHERE part = 'early'")
def _(spark, d):
    out = seg.count_model_by(lines_per_customer(spark, d), "lines", ["part"], ["area"]).coefficients
    return rounded(out.select("area", "term", "coefficient", "std_error"))


@query("ols_segments",
       "WITH f AS (SELECT l_returnflag, l_linestatus, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, "
       "avg(l_quantity) AS mx, regr_sxx(l_extendedprice, l_quantity) AS sxx, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), "
       "e AS (SELECT l_returnflag, l_linestatus, a, b, mx, sxx, n, l_quantity - mx AS xc, l_extendedprice - a - b * l_quantity AS e, "
       "1 / n + power(l_quantity - mx, 2) / sxx AS h FROM lineitem JOIN f USING (l_returnflag, l_linestatus)), "
       "s AS (SELECT l_returnflag, l_linestatus, any_value(a) AS a, any_value(b) AS b, any_value(sxx) AS sxx, sum(e * e / power(1 - h, 2) * xc * xc) AS meat, "
       "sum(e * e / power(1 - h, 2) * power(1 / n - mx * xc / sxx, 2)) AS meat0 FROM e GROUP BY 1, 2) "
       "SELECT l_returnflag, l_linestatus, 'l_quantity' AS term, round(b, 4) AS coefficient, round(sqrt(meat) / sxx, 4) AS std_error FROM s UNION ALL "
       "SELECT l_returnflag, l_linestatus, '(Intercept)', round(a, 4), round(sqrt(meat0), 4) FROM s")
def _(spark, d):
    out = seg.ols_by(lineitem(spark, d), "l_extendedprice", ["l_quantity"], ["l_returnflag", "l_linestatus"]).coefficients
    return rounded(out.select("l_returnflag", "l_linestatus", "term", "coefficient", "std_error"), 4)


@query("logit_segments",
       "WITH k AS (SELECT o_custkey % 5 AS part, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority >= '3') AS DOUBLE) AS a, "
       "CAST(count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority >= '3') AS DOUBLE) AS b, CAST(count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority < '3') AS DOUBLE) AS c, "
       "CAST(count(*) FILTER (o_orderstatus <> 'F' AND o_orderpriority < '3') AS DOUBLE) AS d FROM orders GROUP BY 1) "
       "SELECT part, 'g[b]' AS term, round(ln(a * d / (b * c)), 6) AS coefficient, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS std_error FROM k UNION ALL "
       "SELECT part, '(Intercept)', round(ln(c / d), 6), round(sqrt(1 / c + 1 / d), 6) FROM k")
def _(spark, d):
    out = seg.logit_by(finals(spark, d).withColumn("part", F.col("o_custkey") % 5), "final", ["g"], "yes", ["part"]).coefficients
    return rounded(out.select("part", "term", "coefficient", "std_error"))


@query("quantile_regression")
def _(spark, d):
    fit = r.quantile_regression(lineitem(spark, d), "l_extendedprice", ["l_quantity", "l_discount"], 0.5)
    return rounded(fit.coefficients, 2)
