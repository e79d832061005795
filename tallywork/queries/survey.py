"""Survey-weighted estimation on the derived survey of customers."""

from pyspark.sql import functions as F

from tallywork.operators import survey as s
from tallywork.queries.base import query, rounded, survey, with_survey

DESIGN = {"strata": "stratum", "cluster": "psu"}

# linearized variance of the mean of {y} over the rows where {inside}, per group {g}
MEAN = """
, t AS (SELECT {g} AS g, count(*) AS n, sum(w) AS sw, sum(w * {y}) / sum(w) AS m, avg({y}) AS um FROM survey WHERE {inside} GROUP BY 1),
u AS (SELECT t.g, stratum, psu, sum(CASE WHEN ({inside}) AND {g} = t.g THEN w * ({y} - m) / sw ELSE 0 END) AS u FROM survey, t GROUP BY 1, 2, 3),
v AS (SELECT g, sum(k / (k - 1) * ss) AS var FROM (SELECT g, stratum, CAST(count(*) AS DOUBLE) AS k,
  sum(power(u, 2)) - power(sum(u), 2) / count(*) AS ss FROM u GROUP BY 1, 2) GROUP BY 1)
"""
DOF = "(SELECT count(DISTINCT (stratum, psu)) - count(DISTINCT stratum) FROM survey)"


@query("survey_prepare", with_survey(
    f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_excluded, count(DISTINCT (stratum, psu)) AS n_psu, count(DISTINCT stratum) AS n_strata, {DOF} AS dof FROM survey"))
def _(spark, d):
    x = s.survey_prepare(survey(spark, d), "y", "w", **DESIGN)
    return spark.createDataFrame([(x.n, x.n_excluded, x.n_psu, x.n_strata, x.dof)],
                                 "n long, n_excluded long, n_psu long, n_strata long, dof long")


@query("weighted_mean", with_survey("").rstrip() + MEAN.format(g="segment", y="y", inside="TRUE") +
       f"SELECT g AS segment, n, round(sw, 4) AS sum_of_weights, round(m, 4) AS weighted_mean, round(um, 4) AS unweighted_mean, "
       f"round(sqrt(var), 4) AS standard_error, round(abs(sqrt(var) / m), 6) AS relative_standard_error, CAST({DOF} AS INTEGER) AS dof FROM t JOIN v USING (g)")
def _(spark, d):
    out = s.weighted_mean(survey(spark, d), "y", "w", **DESIGN, by=["segment"])
    return rounded(out.drop("ci95_low", "ci95_high"), 4, relative_standard_error=6)


@query("weighted_mean_overall", with_survey("").rstrip() + MEAN.format(g="'all'", y="y", inside="TRUE") +
       "SELECT n, round(m, 4) AS weighted_mean, round(sqrt(var), 4) AS standard_error FROM t JOIN v USING (g)")
def _(spark, d):
    out = s.weighted_mean(survey(spark, d), "y", "w", **DESIGN)
    return rounded(out.select("n", "weighted_mean", "standard_error"), 4)


@query("linearized_variance", with_survey("").rstrip() +
       ", u AS (SELECT stratum, psu, sum(w * y) AS u FROM survey GROUP BY 1, 2) SELECT round(sum(0.9 * k / (k - 1) * ss) / 1e6, 2) AS variance FROM "
       "(SELECT stratum, CAST(count(*) AS DOUBLE) AS k, sum(power(u, 2)) - power(sum(u), 2) / count(*) AS ss FROM u GROUP BY 1)")
def _(spark, d):
    design = s.survey_prepare(survey(spark, d), "y", "w", **DESIGN, fpc=0.1)
    out = s.linearized_variance(design, design.rows.withColumn("u", F.expr("w * y")))
    return rounded(out.select((F.col("variance") / 1e6).alias("variance")), 2)


@query("weighted_total", with_survey("").rstrip() +
       ", u AS (SELECT g.segment, s.stratum, s.psu, sum(CASE WHEN s.segment = g.segment THEN w * y ELSE 0 END) AS u FROM survey s, "
       "(SELECT DISTINCT segment FROM survey) g GROUP BY 1, 2, 3), v AS (SELECT segment, sum(k / (k - 1) * ss) AS var FROM (SELECT segment, stratum, "
       "CAST(count(*) AS DOUBLE) AS k, sum(power(u, 2)) - power(sum(u), 2) / count(*) AS ss FROM u GROUP BY 1, 2) GROUP BY 1) "
       "SELECT segment, count(*) AS n, round(sum(w), 4) AS sum_of_weights, round(sum(w * y), 2) AS weighted_total, round(sum(y), 2) AS unweighted_sum, "
       "round(sqrt(any_value(var)), 2) AS standard_error FROM survey JOIN v USING (segment) GROUP BY 1")
def _(spark, d):
    out = s.weighted_total(survey(spark, d), "y", "w", **DESIGN, by=["segment"])
    return rounded(out.select("segment", "n", "sum_of_weights", "weighted_total", "unweighted_sum", "standard_error"),
                   2, sum_of_weights=4)


@query("weighted_quantile", with_survey("").rstrip() +
       ", k AS (SELECT segment, y, sum(w) OVER (PARTITION BY segment ORDER BY y) AS cw, sum(w) OVER (PARTITION BY segment) AS tw, "
       "count(*) OVER (PARTITION BY segment ORDER BY y) AS cn, count(*) OVER (PARTITION BY segment) AS tn FROM survey) "
       "SELECT segment, any_value(tn) AS n, round(any_value(tw), 4) AS sum_of_weights, min(y) FILTER (cw >= 0.75 * tw) AS weighted_quantile, "
       "min(y) FILTER (cn >= 0.75 * tn) AS unweighted_quantile FROM k GROUP BY 1")
def _(spark, d):
    out = s.weighted_quantile(survey(spark, d), "y", "w", 0.75, **DESIGN, by=["segment"])
    return rounded(out.select("segment", "n", "sum_of_weights", "weighted_quantile", "unweighted_quantile"), 4)


@query("weighted_median_interval")
def _(spark, d):
    return rounded(s.weighted_quantile(survey(spark, d), "y", "w", 0.5, **DESIGN), 4)


@query("design_effect", with_survey("").rstrip() + MEAN.format(g="segment", y="y", inside="TRUE") +
       ", x AS (SELECT segment AS g, sum(w * power(y - m, 2)) AS ss, count(*) * sum(w * w) / power(sum(w), 2) AS kish, stddev_pop(w) / avg(w) AS cv, "
       "min(w) AS lo, max(w) AS hi FROM survey JOIN t ON g = segment GROUP BY 1) SELECT g AS segment, n, round(kish, 6) AS design_effect_kish, "
       "round(n / kish, 4) AS effective_sample_size, round(var / (ss / sw / (n - 1)), 6) AS design_effect_design_based, round(cv, 6) AS weight_cv, "
       "lo AS weight_min, hi AS weight_max, round(sw, 4) AS sum_of_weights, round(m, 4) AS weighted_mean, round(um, 4) AS unweighted_mean "
       "FROM t JOIN v USING (g) JOIN x USING (g)")
def _(spark, d):
    out = s.design_effect(survey(spark, d), "y", "w", **DESIGN, by=["segment"])
    return rounded(out, 6, effective_sample_size=4, sum_of_weights=4, weighted_mean=4, unweighted_mean=4)


@query("weight_diagnostics", with_survey(
    "SELECT segment, count(*) AS n, round(sum(w), 4) AS sum_of_weights, min(w) AS weight_min, max(w) AS weight_max, "
    "round(stddev_pop(w) / avg(w), 6) AS weight_cv, max(w) / min(w) AS weight_ratio, round(count(*) * sum(w * w) / power(sum(w), 2), 6) AS design_effect_kish, "
    "round(power(sum(w), 2) / sum(w * w), 4) AS effective_sample_size, stddev_pop(w) / avg(w) <= 1 AND max(w) / min(w) <= 50 AS passed "
    "FROM survey GROUP BY 1"))
def _(spark, d):
    out = s.weight_diagnostics(survey(spark, d), "w", by=["segment"])
    return rounded(out, 6, sum_of_weights=4, effective_sample_size=4)


CELLS = with_survey("").rstrip() + ", c AS (SELECT segment, level, sum(w) AS o, count(*) AS n FROM survey GROUP BY 1, 2) "


@query("weighted_crosstab_cells", CELLS +
       "SELECT segment, level, round(o, 4) AS weighted_count, n AS unweighted_count, round(100 * o / sum(o) OVER (PARTITION BY segment), 4) AS row_percent, "
       "round(100 * o / sum(o) OVER (PARTITION BY level), 4) AS column_percent, round(100 * o / sum(o) OVER (), 4) AS total_percent FROM c")
def _(spark, d):
    return rounded(s.weighted_crosstab_cells(survey(spark, d), "segment", "level", "w", **DESIGN), 4)


# design effects of every cell and margin: one indicator at a time over all sampling units
RAO = CELLS + """
, tot AS (SELECT sum(w) AS tw, count(*) AS n FROM survey),
k AS (SELECT 'cell' AS kind, segment AS r, level AS c FROM c UNION ALL SELECT DISTINCT 'row', segment, '' FROM c
  UNION ALL SELECT DISTINCT 'column', '', level FROM c),
z AS (SELECT kind, r, c, stratum, psu, w, CAST((r = '' OR r = segment) AND (c = '' OR c = level) AS DOUBLE) AS z FROM survey, k),
q AS (SELECT kind, r, c, sum(w * z) / sum(w) AS q FROM z GROUP BY ALL),
u AS (SELECT kind, r, c, q, stratum, psu, sum(w * (z - q)) / any_value(tw) AS u FROM z JOIN q USING (kind, r, c), tot GROUP BY ALL),
v AS (SELECT kind, r, c, q, sum(m / (m - 1) * ss) AS var FROM (SELECT kind, r, c, q, stratum, CAST(count(*) AS DOUBLE) AS m,
  sum(u * u) - power(sum(u), 2) / count(*) AS ss FROM u GROUP BY ALL) GROUP BY ALL),
d AS (SELECT *, var / (q * (1 - q) / (n - 1)) AS deff FROM v, tot),
dims AS (SELECT (count(DISTINCT segment) - 1) * (count(DISTINCT level) - 1) AS dof FROM c),
f AS (SELECT (sum((1 - q) * deff) FILTER (kind = 'cell') - sum((1 - q) * deff) FILTER (kind <> 'cell')) / any_value(dof) AS f FROM d, dims),
x AS (SELECT sum(power(a.q - rr.q * cc.q, 2) / (rr.q * cc.q)) AS x2 FROM q a JOIN q rr ON rr.kind = 'row' AND rr.r = a.r
  JOIN q cc ON cc.kind = 'column' AND cc.c = a.c WHERE a.kind = 'cell')
"""


@query("weighted_crosstab", RAO +
       "SELECT round(n * x2 / f, 5) AS statistic, CAST(dof AS INTEGER) AS dof, round(f, 5) AS correction_factor, round(n * x2, 5) AS uncorrected_statistic, "
       "round(tw * x2, 5) AS naive_statistic, n, round(tw, 4) AS estimated_population, "
       "round(sqrt(x2 / (least((SELECT count(DISTINCT segment) FROM c), (SELECT count(DISTINCT level) FROM c)) - 1)), 6) AS cramers_v FROM x, f, tot, dims")
def _(spark, d):
    out = s.weighted_crosstab(survey(spark, d), "segment", "level", "w", **DESIGN)
    return rounded(out.drop("p_value", "design_dof"), 5, estimated_population=4, cramers_v=6)


@query("rao_scott_factor", RAO + "SELECT round(f, 5) AS correction_factor FROM f")
def _(spark, d):
    return rounded(s.rao_scott_factor(survey(spark, d), "segment", "level", "w", **DESIGN), 5)


@query("rao_scott_no_clusters",
       RAO.replace("WITH survey AS (", "WITH designed AS (", 1).replace(
           ", c AS (", ", survey AS (SELECT * REPLACE (0 AS stratum, rid AS psu) FROM designed), c AS (", 1) +
       "SELECT round(n * x2 / f, 5) AS statistic, CAST(dof AS INTEGER) AS dof, round(f, 5) AS correction_factor FROM x, f, tot, dims")
def _(spark, d):
    out = s.weighted_crosstab(survey(spark, d), "segment", "level", "w")
    return rounded(out.select("statistic", "dof", "correction_factor"), 5)


# twenty rows by thirty columns: the cells are many more than a reader would collapse to
@query("weighted_crosstab_wide",
       RAO.replace("WITH survey AS (", "WITH designed AS (", 1).replace(
           ", c AS (", ", survey AS (SELECT * REPLACE (CAST(rid % 20 AS VARCHAR) AS segment, CAST(rid // 20 % 30 AS VARCHAR) AS level) FROM designed), c AS (", 1) +
       "SELECT CASE WHEN filled THEN round(n * x2 / f, 5) END AS statistic, CAST(dof AS INTEGER) AS dof, CASE WHEN filled THEN round(f, 5) END AS correction_factor "
       "FROM x, f, tot, dims, (SELECT count(*) = count(DISTINCT segment) * count(DISTINCT level) AS filled FROM c)")
def _(spark, d):
    wide = survey(spark, d).withColumns({"segment": F.expr("CAST(rid % 20 AS STRING)"), "level": F.expr("CAST(rid DIV 20 % 30 AS STRING)")})
    return rounded(s.weighted_crosstab(wide, "segment", "level", "w", **DESIGN).select("statistic", "dof", "correction_factor"), 5)


# the filtered answer sees only the sampling units that hold a row of the domain
FILTERED = (", fu AS (SELECT stratum, psu, sum(w * (y - m) / sw) AS u FROM survey, t WHERE segment = 'BUILDING' GROUP BY 1, 2), "
            "fv AS (SELECT sum(k / (k - 1) * ss) AS var FROM (SELECT stratum, CAST(count(*) AS DOUBLE) AS k, sum(u * u) - power(sum(u), 2) / count(*) AS ss "
            "FROM fu GROUP BY 1)) ")


@query("subpopulation_estimate", with_survey("").rstrip() + MEAN.format(g="'x'", y="y", inside="segment = 'BUILDING'") + FILTERED +
       "SELECT 'domain' AS approach, n, round(m, 4) AS weighted_mean, round(sqrt(v.var), 4) AS standard_error, 1.0::DOUBLE AS se_ratio FROM t, v "
       "UNION ALL SELECT 'filtered', n, round(m, 4), round(sqrt(fv.var), 4), round(sqrt(fv.var / v.var), 6) FROM t, fv, v")
def _(spark, d):
    out = s.subpopulation_estimate(survey(spark, d), "y", "w", "segment", "BUILDING", **DESIGN)
    return rounded(out.select("approach", "n", "weighted_mean", "standard_error", "se_ratio"), 4, se_ratio=6)
