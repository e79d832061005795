"""Hypothesis tests: statistics, degrees of freedom, sizes and effects against SQL.

p-values and t-based bounds have no counterpart in SQL; the unit tests pin those.
"""

from pyspark.sql import functions as F

from tallywork.operators import counts as c
from tallywork.operators import means as m
from tallywork.operators import ranks as r
from tallywork.queries.base import messy, query, rounded, survey, table, with_messy, with_survey
from tallywork.queries.bivariate import ONE_WAY

PARITY = "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END"


def orders(spark, d):
    return table(spark, d, "orders").withColumn("parity", F.expr(PARITY))


TWO = (f"WITH m AS (SELECT {PARITY} AS g, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS v "
       "FROM orders GROUP BY 1), r AS (SELECT a.n AS n1, b.n AS n2, a.mean AS m1, b.mean AS m2, a.v AS v1, b.v AS v2 "
       "FROM m a, m b WHERE a.g = 'even' AND b.g = 'odd') ")


@query("ttest_one_sample",
       "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, "
       "round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(*))), 6) AS statistic, count(*) - 1 AS dof, "
       "round(avg(value) - 50, 6) AS mean_difference, round((avg(value) - 50) / stddev_samp(value), 6) AS cohens_d "
       "FROM events GROUP BY 1")
def _(spark, d):
    out = m.ttest_one_sample(table(spark, d, "events"), "value", 50, by=["event_type"])
    return rounded(out.drop("p_value", "ci95_low", "ci95_high"))


@query("ttest_independent", TWO +
       "SELECT 'even' AS group1, 'odd' AS group2, n1, n2, round(m1 - m2, 4) AS mean_difference, "
       "round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS statistic, "
       "round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 4) AS dof FROM r")
def _(spark, d):
    out = m.ttest_independent(orders(spark, d), "o_totalprice", "parity")
    return rounded(out.drop("p_value", "ci95_low", "ci95_high", "cohens_d", "hedges_g"), 6, mean_difference=4, dof=4)


@query("ttest_pooled", TWO +
       "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)), 6) "
       "AS statistic, CAST(n1 + n2 - 2 AS DOUBLE) AS dof FROM r")
def _(spark, d):
    out = m.ttest_independent(orders(spark, d), "o_totalprice", "parity", equal_var=True)
    return rounded(out.select("statistic", "dof"))


@query("cohens_d", TWO +
       "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d, "
       "round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3.0::DOUBLE / (4 * (n1 + n2) - 9)), 6) "
       "AS hedges_g FROM r")
def _(spark, d):
    out = m.ttest_independent(orders(spark, d), "o_totalprice", "parity")
    return rounded(out.select("cohens_d", "hedges_g"))


@query("ttest_paired",
       with_messy("SELECT Finished, count(price) AS n, count(*) - count(price) AS n_excluded, "
                  "round(avg(price / 1000 - Progress), 4) AS mean_difference, "
                  "round(avg(price / 1000 - Progress) / (stddev_samp(price / 1000 - Progress) / sqrt(count(price))), 6) AS statistic, "
                  "count(price) - 1 AS dof FROM messy GROUP BY 1"))
def _(spark, d):
    df = messy(spark, d).withColumn("thousands", F.expr("price / 1000"))
    out = m.ttest_paired(df, "thousands", "Progress", by=["Finished"])
    return rounded(out.drop("p_value", "ci95_low", "ci95_high", "cohens_d"), 6, mean_difference=4)


@query("anova", ONE_WAY.format(g="l_returnflag", x="l_extendedprice", t="lineitem") +
       "SELECT k, n, 'classic' AS test, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS statistic, k - 1 AS dof_between, "
       "CAST(n - k AS DOUBLE) AS dof_within, round(ssb / (ssb + ssw), 8) AS eta_squared, "
       "round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 8) AS omega_squared, "
       # three groups: the upper tail of F with 2 numerator degrees of freedom is a power
       "round(power(1 + 2 * (ssb / 2 / (ssw / (n - k))) / (n - k), -(n - k) / 2.0::DOUBLE), 6) AS p_value FROM s")
def _(spark, d):
    out = m.anova(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(out.drop("ss_between", "ss_within", "levene_p", "equal_variance"),
                   6, eta_squared=8, omega_squared=8)


@query("omega_squared", ONE_WAY.format(g="event_type", x="value", t="events") +
       "SELECT round(ssb, 4) AS ss_between, round(ssw, 2) AS ss_within, "
       "round((ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw + ssw / (n - k)), 8) AS omega_squared FROM s")
def _(spark, d):
    out = m.anova(table(spark, d, "events"), "value", "event_type")
    return rounded(out.select("ss_between", "ss_within", "omega_squared"), 4, ss_within=2, omega_squared=8)


@query("welch_anova",
       "WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS mean, var_samp(value) AS v, count(*) / var_samp(value) AS w "
       "FROM events GROUP BY 1), t AS (SELECT count(*) AS k, sum(n) AS n, sum(w) AS tw, sum(w * mean) / sum(w) AS wm FROM m), "
       "s AS (SELECT any_value(k) AS k, any_value(t.n) AS n, sum(w * power(mean - wm, 2)) AS a, "
       "sum(power(1 - w / tw, 2) / (m.n - 1)) AS b FROM m, t) "
       "SELECT k, CAST(n AS BIGINT) AS n, round((a / (k - 1)) / (1 + 2.0::DOUBLE * (k - 2) / (k * k - 1) * b), 6) AS statistic, "
       "k - 1 AS dof_between, round((k * k - 1) / (3 * b), 3) AS dof_within FROM s")
def _(spark, d):
    out = m.welch_anova(table(spark, d, "events"), "value", "event_type")
    return rounded(out.drop("p_value"), 6, dof_within=3)


@query("group_summary",
       "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, "
       "round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY 1")
def _(spark, d):
    out = m.group_summary(table(spark, d, "events"), "value", "event_type")
    return rounded(out.drop("ci95_low", "ci95_high"))


@query("mean_ci", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd "
       "FROM events GROUP BY 1")
def _(spark, d):
    return rounded(m.mean_ci(table(spark, d, "events"), "value", ["event_type"]).drop("ci95_low", "ci95_high"))


# the t quantile by its expansion in 1 / dof around the normal one, right to nine digits from 300 degrees of freedom on
@query("mean_difference_ci", TWO +
       ", w AS (SELECT m1 - m2 AS d, sqrt(v1 / n1 + v2 / n2) AS se, power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)) AS f, "
       "1.959963984540054 AS z FROM r), "
       "t AS (SELECT d, se * (z + (power(z, 3) + z) / (4 * f) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * f * f) "
       "+ (3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / (384 * power(f, 3))) AS half FROM w) "
       "SELECT 'even' AS group1, 'odd' AS group2, round(d, 4) AS mean_difference, round(d - half, 4) AS ci95_low, round(d + half, 4) AS ci95_high FROM t")
def _(spark, d):
    out = m.ttest_independent(orders(spark, d), "o_totalprice", "parity")
    return rounded(out.select("group1", "group2", "mean_difference", "ci95_low", "ci95_high"), 4)


@query("tukey_hsd",
       "WITH m AS (SELECT event_type AS g, count(*) AS n, avg(value) AS mean, var_samp(value) AS v FROM events GROUP BY 1), "
       "e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM m) SELECT a.g AS group1, b.g AS group2, "
       "round(a.mean - b.mean, 6) AS difference, round(abs(a.mean - b.mean) / sqrt(msw / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS q "
       "FROM m a JOIN m b ON a.g < b.g, e")
def _(spark, d):
    out = m.tukey_hsd(table(spark, d, "events"), "value", "event_type")
    return rounded(out.select("group1", "group2", "difference", "q"))


@query("tukey_many_groups",
       "WITH m AS (SELECT CAST(o_custkey % 250 AS VARCHAR) AS g, count(*) AS n, avg(o_totalprice) AS mean, var_samp(o_totalprice) AS v "
       "FROM orders GROUP BY 1 HAVING count(*) > 1), e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS msw FROM m) "
       "SELECT a.g AS group1, b.g AS group2, a.mean > b.mean AS first_is_larger, round(abs(a.mean - b.mean) / sqrt(msw / 2 * (1.0::DOUBLE / a.n + 1.0::DOUBLE / b.n)), 6) AS q FROM m a JOIN m b ON a.g < b.g, e")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("g", F.expr("o_custkey % 250"))
    out = m.tukey_hsd(df, "o_totalprice", "g")
    return rounded(out.select("group1", "group2", (F.col("difference") > 0).alias("first_is_larger"), "q"))


RANKED = ("WITH k AS (SELECT {g} AS g, {x} AS x, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE "
          "AS rk FROM {t}), s AS (SELECT g, count(*) AS n, sum(rk) AS rs, quantile_cont(x, 0.5) AS med FROM k GROUP BY g), "
          "t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM k GROUP BY x)) ")


@query("rank_summary", RANKED.format(g="event_type", x="value", t="events") +
       "SELECT s.g AS event_type, s.n, round(med, 6) AS median, round(q1, 6) AS q1, round(q3, 6) AS q3, round(rs / s.n, 4) AS mean_rank "
       "FROM s JOIN (SELECT event_type AS g, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) USING (g)")
def _(spark, d):
    return rounded(r.rank_summary(table(spark, d, "events"), "value", "event_type"), 6, mean_rank=4)


@query("kruskal", RANKED.format(g="event_type", x="value", t="events") +
       ", h AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(rs * rs / n) AS s, CAST(sum(n) AS DOUBLE) AS m FROM s), "
       "o AS (SELECT k, n, (12 / (m * (m + 1)) * h.s - 3 * (m + 1)) / (1 - ties / (m * m * m - m)) AS st FROM h, t) "
       "SELECT k, n, round(st, 6) AS statistic, k - 1 AS dof, round((st - k + 1) / (n - k), 8) AS eta_squared_rank, "
       # five groups: the chi-square tail with 4 degrees of freedom
       "round(exp(-st / 2) * (1 + st / 2), 6) AS p_value FROM o")
def _(spark, d):
    out = r.kruskal(table(spark, d, "events"), "value", "event_type")
    return rounded(out, 6, eta_squared_rank=8)


@query("mannwhitney", RANKED.format(g=PARITY, x="o_totalprice", t="orders") +
       "SELECT 'even' AS group1, 'odd' AS group2, a.n AS n1, b.n AS n2, a.rs - a.n * (a.n + 1) / 2 AS statistic, "
       "'asymptotic' AS method, round(2 * (a.rs - a.n * (a.n + 1) / 2) / (CAST(a.n AS DOUBLE) * b.n) - 1, 8) AS rank_biserial, "
       "round(a.med - b.med, 4) AS median_difference FROM s a, s b WHERE a.g = 'even' AND b.g = 'odd'")
def _(spark, d):
    out = r.mannwhitney(orders(spark, d), "o_totalprice", "parity")
    return rounded(out.drop("p_value"), 8, median_difference=4)


@query("hodges_lehmann",
       "WITH r AS (SELECT CASE WHEN s_nationkey < 12 THEN 'a' ELSE 'b' END AS g, s_acctbal AS x FROM supplier) SELECT "
       "(SELECT count(*) FROM r WHERE g = 'a') AS n1, (SELECT count(*) FROM r WHERE g = 'b') AS n2, "
       "round(quantile_cont(p.x - q.x, 0.5), 4) AS shift FROM r p, r q WHERE p.g = 'a' AND q.g = 'b'")
def _(spark, d):
    df = table(spark, d, "supplier").withColumn("g", F.expr("CASE WHEN s_nationkey < 12 THEN 'a' ELSE 'b' END"))
    return rounded(r.hodges_lehmann(df, "s_acctbal", "g"), 4)


@query("hodges_lehmann_orders",
       f"WITH r AS (SELECT {PARITY} AS g, o_totalprice AS x FROM orders) SELECT "
       "(SELECT count(*) FROM r WHERE g = 'even') AS n1, (SELECT count(*) FROM r WHERE g = 'odd') AS n2, "
       "round(quantile_cont(p.x - q.x, 0.5), 4) AS shift FROM r p, r q WHERE p.g = 'even' AND q.g = 'odd'")
def _(spark, d):
    return rounded(r.hodges_lehmann(orders(spark, d), "o_totalprice", "parity"), 4)


# three values against all others: every triple of ranks is one arrangement
FEW = "CASE WHEN s_suppkey < 3 THEN 'few' ELSE 'rest' END"


@query("mannwhitney_exact",
       f"WITH k AS (SELECT {FEW} AS g, s_acctbal AS x, row_number() OVER (ORDER BY s_acctbal) AS rk FROM supplier), "
       "u AS (SELECT sum(rk) FILTER (g = 'few') - 6 AS u, count(*) FILTER (g = 'few') AS n1, count(*) FILTER (g = 'rest') AS n2 FROM k), "
       "w AS (SELECT a.rk + b.rk + c.rk - 6 AS v FROM k a JOIN k b ON a.rk < b.rk JOIN k c ON b.rk < c.rk) "
       "SELECT 'few' AS group1, 'rest' AS group2, n1, n2, CAST(u AS DOUBLE) AS statistic, 'exact' AS method, "
       "round(least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (v >= greatest(u, n1 * n2 - u)) / count(*)), 10) AS p_value FROM w, u GROUP BY ALL")
def _(spark, d):
    df = table(spark, d, "supplier").withColumn("g", F.expr(FEW))
    out = r.mannwhitney(df, "s_acctbal", "g")
    return rounded(out.select("group1", "group2", "n1", "n2", "statistic", "method", "p_value"), 10)


@query("wilcoxon",
       with_messy("").rstrip() + ", p AS (SELECT price / 1000 - 2.5 * Progress AS d FROM messy WHERE price IS NOT NULL), "
       "k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM p WHERE d <> 0) "
       "SELECT least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS statistic, sum(rk) FILTER (d > 0) AS w_plus, "
       "sum(rk) FILTER (d < 0) AS w_minus, count(*) AS n_pairs, (SELECT count(*) FROM p) AS n_complete, "
       "(SELECT count(*) FROM p WHERE d = 0) AS n_tied, "
       "round((sum(rk) FILTER (d > 0) - sum(rk) FILTER (d < 0)) / sum(rk), 8) AS rank_biserial, "
       "(SELECT round(quantile_cont(d, 0.5), 4) FROM p) AS median_difference FROM k")
def _(spark, d):
    df = messy(spark, d).selectExpr("price / 1000 AS a", "2.5 * Progress AS b")
    return rounded(r.wilcoxon(df, "a", "b").drop("p_value", "method"), 8, median_difference=4)


# ------------------------------------------------------------------------------ counts

CELLS = ("WITH cells AS (SELECT {r} AS r, {c} AS c, count(*) AS o FROM {t} GROUP BY 1, 2), "
         "rt AS (SELECT r, sum(o) AS rt FROM cells GROUP BY r), ct AS (SELECT c, sum(o) AS ct FROM cells GROUP BY c), "
         "n AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM cells), "
         "e AS (SELECT rt.r, ct.c, coalesce(o, 0) AS o, rt * ct / n AS e FROM rt CROSS JOIN ct CROSS JOIN n "
         "LEFT JOIN cells USING (r, c)), "
         "k AS (SELECT (SELECT count(*) FROM rt) AS nr, (SELECT count(*) FROM ct) AS nc, sum(power(o - e, 2) / e) AS x2, "
         "sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e) AS y2, min(e) AS me, sum(o) AS n FROM e) ")
CHI = ("SELECT CAST(n AS BIGINT) AS n, nr AS n_rows, nc AS n_columns, "
       "round(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN y2 ELSE x2 END, 5) AS statistic, (nr - 1) * (nc - 1) AS dof, "
       "round(x2, 5) AS chi2_uncorrected, round(sqrt(x2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v, "
       "round(me, 4) AS min_expected, me >= 5 AS expected_ok FROM k")


@query("chi_square_independence", CELLS.format(r="l_returnflag", c="l_linestatus", t="lineitem") +
       CHI.replace(" FROM k", ", round(exp(-x2 / 2), 6) AS p_value FROM k"))
def _(spark, d):
    out = c.chi_square_independence(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(out, 5, p_value=6, cramers_v=6, min_expected=4)


@query("chi_square_yates", with_survey("").rstrip() + ", " + CELLS.format(
    r="level", c="CASE WHEN w > 1 THEN 'a' ELSE 'b' END", t="survey")[5:] + CHI)
def _(spark, d):
    df = survey(spark, d).withColumn("heavy", F.expr("CASE WHEN w > 1 THEN 'a' ELSE 'b' END"))
    out = c.chi_square_independence(df, "level", "heavy")
    return rounded(out.drop("p_value"), 5, cramers_v=6, min_expected=4)


@query("cramers_v", CELLS.format(r="o_orderstatus", c="o_orderpriority", t="orders") +
       "SELECT round(sqrt(x2 / (n * (least(nr, nc) - 1))), 6) AS cramers_v FROM k")
def _(spark, d):
    return rounded(c.chi_square_independence(
        table(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select("cramers_v"))


@query("crosstab_chi_square", CELLS.format(r="o_orderstatus", c="o_orderpriority", t="orders") +
       "SELECT round(x2, 4) AS chi2, (nr - 1) * (nc - 1) AS dof, round(exp(-x2 / 2) * (1 + x2 / 2 + x2 * x2 / 8 + power(x2, 3) / 48), 6) "
       "AS p_value FROM k")
def _(spark, d):
    out = c.chi_square_independence(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")
    return rounded(out.selectExpr("statistic AS chi2", "dof", "p_value"), 4, p_value=6)


@query("expected_counts", CELLS.format(r="o_orderstatus", c="o_orderpriority", t="orders") +
       "SELECT r AS o_orderstatus, c AS o_orderpriority, o AS observed, round(e, 6) AS expected FROM e")
def _(spark, d):
    return rounded(c.expected_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("check_expected_counts", CELLS.format(r="o_orderstatus", c="o_orderpriority", t="orders") +
       "SELECT round(min(e), 6) AS smallest, count(*) FILTER (e < 5) AS n_below, count(*) AS n_cells, min(e) >= 5 AS passed FROM e")
def _(spark, d):
    return rounded(c.check_expected_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"))


@query("fisher_exact",
       with_survey("SELECT 'high' AS row1, 'low' AS row2, count(*) FILTER (level = 'high' AND w <= 1) AS a, "
                   "count(*) FILTER (level = 'high' AND w > 1) AS b, count(*) FILTER (level = 'low' AND w <= 1) AS c, "
                   "count(*) FILTER (level = 'low' AND w > 1) AS d, round(count(*) FILTER (level = 'high' AND w <= 1) * "
                   "CAST(count(*) FILTER (level = 'low' AND w > 1) AS DOUBLE) / (count(*) FILTER (level = 'high' AND w > 1) * "
                   "CAST(count(*) FILTER (level = 'low' AND w <= 1) AS DOUBLE)), 6) AS odds_ratio FROM survey"))
def _(spark, d):
    df = survey(spark, d).withColumn("heavy", F.expr("CASE WHEN w > 1 THEN 'yes' ELSE 'no' END"))
    return rounded(c.fisher_exact(df, "level", "heavy").drop("p_value", "column1", "column2"))


@query("chi_square_goodness_of_fit",
       "WITH k AS (SELECT event_type, count(*) AS o FROM events GROUP BY 1), a AS (SELECT count(*) AS k, sum(o) AS n, avg(o) AS e FROM k) "
       "SELECT CAST(any_value(n) AS BIGINT) AS n, round(sum(power(o - e, 2) / e), 6) AS statistic, any_value(a.k) - 1 AS dof, "
       "round(any_value(e), 4) AS expected, round(sqrt(sum(power(o - e, 2) / e) / any_value(n)), 6) AS cohens_w, "
       "round(exp(-sum(power(o - e, 2) / e) / 2) * (1 + sum(power(o - e, 2) / e) / 2), 6) AS p_value FROM k, a")
def _(spark, d):
    return rounded(c.chi_square_goodness_of_fit(table(spark, d, "events"), "event_type"), 6, expected=4)


Z = "1.959963984540054::DOUBLE"
WILSON = ("({p} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n}) {s} {z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) "
          "/ (1 + {z} * {z} / {n})")
LOW = WILSON.format(p="p", n="n", z=Z, s="-")
HIGH = WILSON.format(p="p", n="n", z=Z, s="+")


@query("proportion_test_one_sample",
       "WITH s AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (o_orderstatus = 'F') AS x, "
       "count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS p FROM orders GROUP BY 1) "
       "SELECT o_orderpriority, CAST(n AS BIGINT) AS n, x AS successes, round(p, 6) AS proportion, "
       f"round((p - 0.3) / sqrt(0.21::DOUBLE / n), 6) AS statistic, round({LOW}, 6) AS ci95_low, round({HIGH}, 6) AS ci95_high, "
       "round(2 * asin(sqrt(p)) - 2 * asin(sqrt(0.3::DOUBLE)), 6) AS cohens_h, n * 0.3 >= 5 AS expected_ok FROM s")
def _(spark, d):
    out = c.proportion_test(table(spark, d, "orders"), "o_orderstatus", "F", 0.3, by=["o_orderpriority"])
    return rounded(out.drop("p_value"))


PROPS = (f"WITH g AS (SELECT {PARITY} AS g, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (o_orderstatus = 'F') AS x FROM orders GROUP BY 1), "
         "q AS (SELECT g, n, x, x / n AS p FROM g), w AS (SELECT *, " + f"{LOW} AS l, {HIGH} AS u FROM q), "
         "r AS (SELECT a.n AS n1, b.n AS n2, a.x AS x1, b.x AS x2, a.p AS p1, b.p AS p2, a.l AS l1, a.u AS u1, b.l AS l2, b.u AS u2, "
         "(a.x + b.x) / (a.n + b.n) AS pool FROM w a, w b WHERE a.g = 'even' AND b.g = 'odd') ")


@query("proportion_test_two_sample", PROPS +
       "SELECT 'even' AS group1, 'odd' AS group2, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(p1, 6) AS p1, round(p2, 6) AS p2, "
       "round((p1 - p2) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)), 6) AS statistic, round(p1 - p2, 6) AS difference, "
       "round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) AS cohens_h, TRUE AS expected_ok FROM r")
def _(spark, d):
    out = c.proportion_test_two(orders(spark, d), "o_orderstatus", "F", "parity")
    return rounded(out.drop("p_value", "ci95_low", "ci95_high"))


@query("newcombe_ci", PROPS +
       "SELECT round(p1 - p2 - sqrt(power(p1 - l1, 2) + power(u2 - p2, 2)), 6) AS ci95_low, "
       "round(p1 - p2 + sqrt(power(u1 - p1, 2) + power(p2 - l2, 2)), 6) AS ci95_high FROM r")
def _(spark, d):
    out = c.proportion_test_two(orders(spark, d), "o_orderstatus", "F", "parity")
    return rounded(out.select("ci95_low", "ci95_high"))


@query("cohens_h", PROPS + "SELECT round(2 * asin(sqrt(p1)) - 2 * asin(sqrt(p2)), 6) AS cohens_h FROM r")
def _(spark, d):
    return rounded(c.proportion_test_two(orders(spark, d), "o_orderstatus", "F", "parity").select("cohens_h"))


@query("wilson_ci",
       "WITH s AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY 1) "
       f"SELECT lang, round(greatest(0, {LOW}), 6) AS ci95_low, round(least(1, {HIGH}), 6) AS ci95_high FROM s")
def _(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    out = c.proportion_test(df, "quality", 1, 0.5, by=["lang"])
    return rounded(out.select("lang", "ci95_low", "ci95_high"))


# -------------------------------------------------------------------------- assumptions


@query("normality_test",
       "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, "
       "round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis, "
       "CASE WHEN count(*) <= 5000 THEN 'shapiro' ELSE 'dagostino' END AS test FROM events GROUP BY 1")
def _(spark, d):
    out = m.normality_test(table(spark, d, "events"), "value", "event_type")
    return rounded(out.drop("statistic", "p_value", "normal", "mean_robust"))


K2 = ("WITH c AS (SELECT l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem) AS x FROM lineitem), "
      "q AS (SELECT CAST(count(*) AS DOUBLE) AS m, avg(power(x, 3)) / power(avg(x * x), 1.5) AS g1, avg(power(x, 4)) / power(avg(x * x), 2) AS b2 FROM c), "
      "a AS (SELECT *, g1 * sqrt((m + 1) * (m + 3) / (6 * (m - 2))) AS y, 3 * (m * m + 27 * m - 70) * (m + 1) * (m + 3) / ((m - 2) * (m + 5) * (m + 7) * (m + 9)) AS beta, "
      "(b2 - 3 * (m - 1) / (m + 1)) / sqrt(24 * m * (m - 2) * (m - 3) / (power(m + 1, 2) * (m + 3) * (m + 5))) AS x, "
      "6 * (m * m - 5 * m + 2) / ((m + 7) * (m + 9)) * sqrt(6 * (m + 3) * (m + 5) / (m * (m - 2) * (m - 3))) AS rb FROM q), "
      "b AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS aa FROM a), "
      "z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, "
      "((1 - 2 / (9 * aa)) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)) AS z2 FROM b) ")


@query("normality_test_large", K2 +
       "SELECT '(all rows)' AS \"group\", CAST(m AS BIGINT) AS n, CASE WHEN m <= 5000 THEN 'shapiro' ELSE 'dagostino' END AS test, "
       "CASE WHEN m > 5000 THEN round(z1 * z1 + z2 * z2, 3) END AS statistic, "
       "CASE WHEN m > 5000 THEN round(exp(-(z1 * z1 + z2 * z2) / 2), 6) END AS p_value FROM z")
def _(spark, d):
    out = m.normality_test(table(spark, d, "lineitem"), "l_extendedprice")
    return rounded(out.select("group", "n", "test", "statistic", "p_value"), 3, p_value=6)


@query("check_normality")
def _(spark, d):
    return rounded(m.check_normality(table(spark, d, "events"), "value", "event_type"))


@query("check_equal_variance",
       "WITH md AS (SELECT event_type AS g, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1), r AS "
       "(SELECT g, abs(value - med) AS x FROM events JOIN md ON g = event_type), "
       "m AS (SELECT g, count(*) AS n, avg(x) AS mean, var_samp(x) AS v FROM r GROUP BY g), "
       "a AS (SELECT sum(n * mean) / sum(n) AS gm FROM m), s AS (SELECT count(*) AS k, sum(n) AS n, "
       "sum(n * power(mean - gm, 2)) AS ssb, sum((n - 1) * v) AS ssw FROM m, a) "
       "SELECT round(ssb / (k - 1) / (ssw / (n - k)), 6) AS statistic, k - 1 AS dof_between, CAST(n - k AS BIGINT) AS dof_within FROM s")
def _(spark, d):
    out = m.check_equal_variance(table(spark, d, "events"), "value", "event_type")
    return rounded(out.drop("p_value", "passed"))


@query("check_group_sizes",
       "SELECT CAST(l_linenumber AS STRING) AS smallest_group, count(*) AS n, count(*) >= 5 AS passed FROM lineitem "
       "GROUP BY l_linenumber ORDER BY count(*), l_linenumber LIMIT 1")
def _(spark, d):
    return m.check_group_sizes(table(spark, d, "lineitem"), "l_quantity", "l_linenumber")


@query("check_paired_completeness",
       with_messy("SELECT count(*) FILTER (price <> 1000) AS n_pairs, count(*) FILTER (price IS NULL) AS n_dropped, "
                  "count(*) FILTER (price = 1000) AS n_tied, CASE WHEN count(*) FILTER (price IS NULL OR price = 1000) = 0 "
                  "THEN TRUE END AS passed FROM messy"))
def _(spark, d):
    df = messy(spark, d).withColumn("fixed", F.lit(1000.0))
    return m.check_paired_completeness(df, "price", "fixed")


# a family of p-values that both engines can compute: a function of each brand's counts
FAMILY = ("SELECT p_brand AS label, 'share' AS test, CASE WHEN count(*) % 7 = 0 THEN NULL ELSE "
          "CAST(count(*) FILTER (WHERE p_size <= 3) AS DOUBLE) / count(*) END AS p_value FROM part GROUP BY 1")


@query("benjamini_hochberg",
       f"WITH f AS ({FAMILY}), k AS (SELECT *, row_number() OVER (ORDER BY p_value, label) AS i, count(*) OVER () AS m FROM f "
       "WHERE p_value IS NOT NULL) SELECT label, round(p_value, 6) AS p_value, CASE WHEN p_value IS NULL THEN NULL ELSE "
       "round(least(1, min(p_value * m / i) OVER (ORDER BY i DESC)), 6) END AS p_adjusted FROM k UNION ALL "
       "SELECT label, NULL, NULL FROM f WHERE p_value IS NULL")
def _(spark, d):
    family = spark.sql(FAMILY.replace("part GROUP", "{part} GROUP"), part=table(spark, d, "part"))
    return rounded(c.benjamini_hochberg(family).select("label", "p_value", "p_adjusted"))


# three tests whose tails have closed forms, adjusted as one family
FAMILY_SQL = (
    ONE_WAY.format(g="l_returnflag", x="l_extendedprice", t="lineitem").rstrip() +
    ", a1 AS (SELECT 'price by flag' AS label, 'anova' AS test, power(1 + 2 * (ssb / 2 / (ssw / (n - k))) / (n - k), -(n - k) / 2.0::DOUBLE) AS p FROM s), " +
    "g AS (SELECT event_type, count(*) AS o FROM events GROUP BY 1), g2 AS (SELECT sum(power(o - e, 2) / e) AS x FROM g, (SELECT avg(o) AS e FROM g)), "
    "a2 AS (SELECT 'event types' AS label, 'goodness_of_fit' AS test, exp(-x / 2) * (1 + x / 2) AS p FROM g2), " +
    "c1 AS (SELECT l_returnflag AS r, l_linestatus AS c, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2), "
    "c2 AS (SELECT sum(power(o - e, 2) / e) AS x FROM (SELECT o, sum(o) OVER (PARTITION BY r) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM c1)), "
    "a3 AS (SELECT 'flag by status' AS label, 'chi_square' AS test, exp(-x / 2) AS p FROM c2), "
    "f AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3), "
    "k AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM f), "
    "q AS (SELECT label, test, p, least(1, min(p * m / i) OVER (ORDER BY i DESC)) AS adj FROM k) "
    "SELECT label, test, round(p, 6) AS p_value, round(adj, 6) AS p_adjusted, adj < 0.05 AS significant FROM q")


@query("test_family_adjustment", FAMILY_SQL)
def _(spark, d):
    lines, events = table(spark, d, "lineitem"), table(spark, d, "events")
    return rounded(c.test_family({
        "price by flag": ("anova", m.anova(lines, "l_extendedprice", "l_returnflag")),
        "event types": ("goodness_of_fit", c.chi_square_goodness_of_fit(events, "event_type")),
        "flag by status": ("chi_square", c.chi_square_independence(lines, "l_returnflag", "l_linestatus")),
    }))
