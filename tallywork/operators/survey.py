"""Design-based survey estimation: everything is sums over primary sampling units.

A design is weights with optional strata, sampling units and a sampling fraction. Without
sampling units every row is its own unit, and the unit step falls away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window as W

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import number, quoted
from tallywork.operators.means import _attach
from tallywork.operators.ordering import running_sums
from tallywork.session import cut_lineage


@dataclass
class Design:
    """Usable rows (domain columns, y, w, h, p) and the counts of the whole design."""

    rows: DataFrame
    strata: DataFrame  # h, n_h: sampling units per stratum
    by: list[str]
    clustered: bool
    fpc: float
    n: int
    n_excluded: int
    n_psu: int
    n_strata: int

    @property
    def dof(self) -> int:
        return self.n_psu - self.n_strata


def survey_prepare(
    df: DataFrame, column: str | None, weights: str, strata: str | None = None,
    cluster: str | None = None, fpc: float | None = None, by=(),
) -> Design:
    """Listwise deletion, refusal of negative weights and of strata with one unit."""
    by = list(by)
    used = [c for c in (column, strata, cluster, *by) if c]
    need_columns(df, [weights, *used])
    if weights in used:
        raise Refusal("the weight column cannot have a second role")
    label = lambda c: quoted(c).cast("string")
    rows = df.select(
        *[label(b).alias(b) for b in by],
        (number(quoted(column)) if column else F.lit(0.0)).alias("y"),
        number(quoted(weights)).alias("w"),
        (label(strata) if strata else F.lit("")).alias("h"),
        *([label(cluster).alias("p")] if cluster else []),
    )
    complete = rows.dropna()
    seen = complete.agg(
        F.count("*").alias("n"), F.min("w").alias("least"), F.count_if(F.col("w") > 0).alias("used")
    ).first()
    if seen["least"] is not None and seen["least"] < 0:
        raise Refusal(f"weight column '{weights}' holds negative values")
    if not seen["used"]:
        raise Refusal(f"no positive weights remain in '{weights}'")
    usable = complete.where("w > 0")
    units = usable.groupBy("h", "p").agg(F.lit(1)).groupBy("h") if cluster else usable.groupBy("h")
    per_stratum = units.agg(F.count("*").alias("n_h"))
    counts = per_stratum.agg(
        F.sum("n_h").alias("psu"), F.count("*").alias("strata"), F.min("n_h").alias("least")).first()
    if counts["least"] < 2:
        alone = [r["h"] for r in per_stratum.where("n_h < 2").limit(5).collect()]
        unit = "PSU" if cluster else "respondent"
        raise Refusal(f"stratum/strata {alone} contain 1 {unit} each; a variance needs at least 2")
    return Design(
        usable, per_stratum, by, cluster is not None, float(fpc or 0.0), seen["used"],
        df.count() - seen["used"], counts["psu"], counts["strata"])


def linearized_variance(design: Design, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Variance of the total of ``u`` per domain. Units of a stratum that hold no row of the
    domain count as zeros, which needs only the number of units of the stratum."""
    by = design.by if by is None else by
    if design.clustered:
        rows = rows.groupBy(*by, "h", "p").agg(F.sum("u").alias("u"))
    sums = rows.groupBy(*by, "h").agg(F.sum(F.expr("u * u")).alias("s2"), F.sum("u").alias("s1"))
    joined = sums.join(design.strata, "h")
    part = F.expr("n_h / (n_h - 1) * (s2 - s1 * s1 / n_h)") * (1.0 - design.fpc)
    return joined.groupBy(*by).agg(F.greatest(F.lit(0.0), F.sum(part)).alias("variance"))


def _interval(df: DataFrame, design: Design, value: str) -> DataFrame:
    margin = dist.t_ppf(F.lit(0.975), F.lit(float(design.dof))) * F.col("standard_error")
    return df.withColumn("_m", margin).withColumns({
        "ci95_low": F.col(value) - F.col("_m"), "ci95_high": F.col(value) + F.col("_m"),
        "relative_standard_error": F.abs(F.col("standard_error") / F.expr(f"nullif({value}, 0)")),
        "dof": F.lit(design.dof),
    }).drop("_m")


def _totals(design: Design) -> DataFrame:
    return design.rows.groupBy(*design.by).agg(
        F.count("*").alias("n"), F.sum("w").alias("sum_of_weights"),
        F.sum(F.expr("w * y")).alias("wy"), F.avg("y").alias("unweighted_mean"),
        F.sum("y").alias("unweighted_sum"))


def _linear_mean(design: Design, totals: DataFrame, y: str = "y") -> DataFrame:
    """Rows with u, the linearized contribution to the weighted mean of ``y``."""
    means = totals.select(*design.by, (F.col("wy") / F.col("sum_of_weights")).alias("_m"),
                          F.col("sum_of_weights").alias("_w"))
    both = _attach(design.rows, means, design.by)
    return both.withColumn("u", F.expr(f"w * ({y} - _m) / _w"))


def weighted_mean(df, column, weights, strata=None, cluster=None, fpc=None, by=()) -> DataFrame:
    """Ratio mean with its linearized error, per domain; all domains share the full design."""
    design = survey_prepare(df, column, weights, strata, cluster, fpc, by)
    return _mean_of(design)


def _mean_of(design: Design) -> DataFrame:
    totals = _totals(design)
    variance = linearized_variance(design, _linear_mean(design, totals))
    out = _attach(totals, variance, design.by).selectExpr(
        *design.by, "n", "sum_of_weights", "wy / sum_of_weights AS weighted_mean", "unweighted_mean",
        "sqrt(variance) AS standard_error")
    return _interval(out, design, "weighted_mean")


def weighted_total(df, column, weights, strata=None, cluster=None, fpc=None, by=()) -> DataFrame:
    design = survey_prepare(df, column, weights, strata, cluster, fpc, by)
    variance = linearized_variance(design, design.rows.withColumn("u", F.expr("w * y")))
    out = _attach(_totals(design), variance, design.by).selectExpr(
        *design.by, "n", "sum_of_weights", "wy AS weighted_total", "unweighted_sum",
        "sqrt(variance) AS standard_error")
    return _interval(out, design, "weighted_total")


def weighted_quantile(
    df, column, weights, quantile=0.5, strata=None, cluster=None, fpc=None, by=()
) -> DataFrame:
    """Lower inverse of the weighted distribution with Woodruff's interval.

    Rows collapse to distinct values first; cumulative weights run range by range.
    """
    design = survey_prepare(df, column, weights, strata, cluster, fpc, by)
    by, p = design.by, float(quantile)
    held = design.rows.groupBy(*by, "y").agg(F.sum("w").alias("wv"), F.count("*").alias("nv"))
    steps = running_sums(held, "y", {"w_before": "wv", "n_before": "nv"}, by)
    totals = design.rows.groupBy(*by).agg(
        F.sum("w").alias("sum_of_weights"), F.count("*").alias("n"))
    cdf = _attach(steps, totals, by)
    reached = lambda target: F.min(F.when(
        F.col("w_before") + F.col("wv") >= target * F.col("sum_of_weights"), F.col("y")))
    point = cdf.groupBy(*by).agg(
        reached(F.lit(p)).alias("weighted_quantile"), F.max("y").alias("_top"),
        F.min(F.when(F.col("n_before") + F.col("nv") >= F.lit(p) * F.col("n"), F.col("y")))
        .alias("unweighted_quantile"))
    point = point.withColumn("weighted_quantile", F.coalesce("weighted_quantile", "_top")).drop("_top")
    below = _attach(design.rows, point.select(*by, F.col("weighted_quantile").alias("_q")), by)
    below = below.withColumn("b", F.expr("CAST(y <= _q AS DOUBLE)"))
    share = below.groupBy(*by).agg((F.sum(F.expr("w * b")) / F.sum("w")).alias("_m"), F.sum("w").alias("_w"))
    u = _attach(below, share, by).withColumn("u", F.expr("w * (b - _m) / _w"))
    variance = linearized_variance(design, u)
    t = dist.t_ppf(F.lit(0.975), F.lit(float(design.dof)))
    bounds = _attach(point, variance, by).withColumn("_t", t).withColumn(
        "_half", F.col("_t") * F.sqrt("variance"))
    bounds = bounds.withColumns({
        "_lo": F.least(F.greatest(F.lit(p) - F.col("_half"), F.lit(1e-12)), F.lit(1.0)),
        "_hi": F.least(F.greatest(F.lit(p) + F.col("_half"), F.lit(1e-12)), F.lit(1.0)),
    })
    ends = _attach(cdf, bounds.select(*by, "_lo", "_hi"), by).groupBy(*by).agg(
        F.coalesce(reached(F.col("_lo")), F.max("y")).alias("ci95_low"),
        F.coalesce(reached(F.col("_hi")), F.max("y")).alias("ci95_high"))
    out = _attach(_attach(bounds, ends, by), totals, by)
    return out.select(
        *by, "n", "sum_of_weights", "weighted_quantile", "unweighted_quantile",
        F.expr("(ci95_high - ci95_low) / (2 * _t)").alias("standard_error"),
        "ci95_low", "ci95_high", F.lit(design.dof).alias("dof"))


def design_effect(df, column, weights, strata=None, cluster=None, fpc=None, by=()) -> DataFrame:
    """Kish's effect from the weights alone, and design variance over simple sampling."""
    design = survey_prepare(df, column, weights, strata, cluster, fpc, by)
    by, totals = design.by, _totals(design)
    linear = _linear_mean(design, totals)
    spread = linear.groupBy(*by).agg(F.sum(F.expr("w * power(y - _m, 2)")).alias("ss"))
    profile = _profile(design.rows, by)
    out = _attach(_attach(profile, linearized_variance(design, linear), by), spread, by)
    out = _attach(out, totals.selectExpr(
        *by, "wy / sum_of_weights AS weighted_mean", "unweighted_mean"), by)
    return out.selectExpr(
        *by, "n", "design_effect_kish", "n / design_effect_kish AS effective_sample_size",
        "variance / nullif(ss / sum_of_weights / (n - 1), 0) AS design_effect_design_based",
        "weight_cv", "weight_min", "weight_max", "sum_of_weights", "weighted_mean", "unweighted_mean")


def _profile(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("w").alias("sum_of_weights"), F.min("w").alias("weight_min"),
        F.max("w").alias("weight_max"), (F.stddev_pop("w") / F.avg("w")).alias("weight_cv"),
        (F.count("*") * F.sum(F.expr("w * w")) / F.pow(F.sum("w"), 2)).alias("design_effect_kish"))


def weight_diagnostics(df: DataFrame, weights: str, by=()) -> DataFrame:
    """Size, spread and cost of the weights; fails past a CV of 1 or a ratio of 50."""
    design = survey_prepare(df, None, weights, by=by)
    return _profile(design.rows, design.by).selectExpr(
        *design.by, "n", "sum_of_weights", "weight_min", "weight_max", "weight_cv",
        "weight_max / weight_min AS weight_ratio", "design_effect_kish",
        "n / design_effect_kish AS effective_sample_size",
        "weight_cv <= 1.0 AND weight_max / weight_min <= 50.0 AS passed")


def subpopulation_estimate(
    df, column, weights, subpopulation, value, strata=None, cluster=None, fpc=None
) -> DataFrame:
    """Domain mean beside the filter-then-analyze answer, which loses part of the design."""
    design = survey_prepare(df, column, weights, strata, cluster, fpc, [subpopulation])
    inside = design.rows.where(quoted(subpopulation) == F.lit(str(value)))
    n_inside = inside.count()
    if n_inside < 2:
        raise Refusal(f"subpopulation_estimate: {n_inside} respondent(s) in {subpopulation} = {value!r}")
    domain = Design(inside, design.strata, [], design.clustered, design.fpc, n_inside, 0,
                    design.n_psu, design.n_strata)
    correct = _mean_of(domain).withColumn("approach", F.lit("domain"))
    try:
        wanted = quoted(subpopulation).cast("string") == F.lit(str(value))
        naive = weighted_mean(df.where(wanted), column, weights, strata, cluster, fpc)
    except Refusal:
        return correct.withColumn("se_ratio", F.lit(None).cast("double"))
    both = correct.unionByName(naive.withColumn("approach", F.lit("filtered")))
    domain_se = F.max(F.when(F.col("approach") == "domain", F.col("standard_error"))).over(W.partitionBy())
    return both.withColumn("se_ratio", F.col("standard_error") / domain_se)


# --------------------------------------------------------------------------- crosstab


def _crosstab_design(df, row, column, weights, strata, cluster, fpc) -> Design:
    if row == column:
        raise Refusal("weighted_crosstab: row and column must be different columns")
    design = survey_prepare(df, None, weights, strata, cluster, fpc, [row, column])
    design.rows = design.rows.select(
        quoted(row).alias("r"), quoted(column).alias("c"), "w", "h", *(["p"] if cluster else []))
    return design


def weighted_crosstab_cells(df, row, column, weights, strata=None, cluster=None, fpc=None) -> DataFrame:
    design = _crosstab_design(df, row, column, weights, strata, cluster, fpc)
    cells = design.rows.groupBy("r", "c").agg(
        F.sum("w").alias("weighted_count"), F.count("*").alias("unweighted_count"))
    total = F.lit(float(design.rows.agg(F.sum("w")).first()[0]))
    share = lambda k: F.col("weighted_count") * 100 / F.sum("weighted_count").over(W.partitionBy(k))
    return cells.select(
        F.col("r").alias(row), F.col("c").alias(column), "weighted_count", "unweighted_count",
        share("r").alias("row_percent"), share("c").alias("column_percent"),
        (F.col("weighted_count") * 100 / total).alias("total_percent"))


def indicator_effects(design: Design) -> DataFrame:
    """Design effect of the estimated share of every cell and margin, in one pass.

    With z the indicator weight and t the whole weight of a unit, the linearized unit value
    is (z - q t) / W, so its stratum sums come from z², z t, z, t² and t.
    """
    q = design.rows
    units = ["h", "p"] if design.clustered else ["h"]
    if design.clustered:
        cells = q.groupBy("r", "c", "h", "p").agg(F.sum("w").alias("z"))
        t = q.groupBy("h", "p").agg(F.sum("w").alias("t"))
    else:
        cells = q.select("r", "c", "h", F.col("w").alias("z"))
        t = q.select("h", F.col("w").alias("t"))
    none = F.lit(None).cast("string")
    kinds = F.array(
        F.struct(F.lit("cell").alias("kind"), F.col("r").alias("kr"), F.col("c").alias("kc")),
        F.struct(F.lit("row").alias("kind"), F.col("r").alias("kr"), none.alias("kc")),
        F.struct(F.lit("column").alias("kind"), none.alias("kr"), F.col("c").alias("kc")))
    spread = cells.select(*units, "z", F.explode(kinds).alias("k")).select(*units, "z", "k.*")
    key = ["kind", "kr", "kc"]
    if design.clustered:
        spread = spread.groupBy(*key, "h", "p").agg(F.sum("z").alias("z")).join(t, ["h", "p"])
    else:
        spread = spread.withColumn("t", F.col("z"))
    per = spread.groupBy(*key, "h").agg(
        F.sum(F.expr("z * z")).alias("zz"), F.sum(F.expr("z * t")).alias("zt"), F.sum("z").alias("z"))
    whole = t.groupBy("h").agg(F.sum(F.expr("t * t")).alias("tt"), F.sum("t").alias("t")).join(
        design.strata, "h")
    total = F.lit(float(t.agg(F.sum("t")).first()[0]))
    # A stratum without a row of the indicator adds q² of its own spread. So the spread of all strata is one number,
    # and only strata that have rows of the indicator are met with it.
    bessel = F.col("n_h") / (F.col("n_h") - 1) * (1.0 - design.fpc)
    spread_all = F.lit(float(whole.agg(F.sum(bessel * F.expr("tt - t * t / n_h"))).first()[0]))
    shares = per.groupBy(*key).agg((F.sum("z") / total).alias("q"))
    met = per.withColumnRenamed("z", "zs").join(whole, "h").join(
        shares.select(*[F.col(k).alias(f"_{k}") for k in key], "q"),
        F.col("kind").eqNullSafe(F.col("_kind")) & F.col("kr").eqNullSafe(F.col("_kr")) & F.col("kc").eqNullSafe(F.col("_kc")))
    own = bessel * F.expr("zz - 2 * q * zt - (zs * zs - 2 * q * zs * t) / n_h")
    out = met.groupBy(*key).agg(F.first("q").alias("q"), F.sum(own).alias("own"))
    out = out.withColumn("variance", (F.col("own") + F.col("q") * F.col("q") * spread_all) / total / total)
    srs = F.expr(f"q * (1 - q) / ({design.n} - 1)")
    return out.select(
        "kind", F.col("kr").alias("r"), F.col("kc").alias("c"), "q",
        (F.col("variance") / F.when(srs > 0, srs)).alias("deff"))


def weighted_crosstab(df, row, column, weights, strata=None, cluster=None, fpc=None, max_cells: int | None = None) -> DataFrame:
    """First-order Rao-Scott test of independence, with the naive statistic for contrast.

    Cells and margins stay a frame; a few sums over them come to the driver. ``max_cells`` refuses larger tables.
    """
    design = _crosstab_design(df, row, column, weights, strata, cluster, fpc)
    effects = cut_lineage(indicator_effects(design))
    of = lambda kind: effects.where(F.col("kind") == kind)
    margins = effects.groupBy("kind").agg(
        F.count("*").alias("n"), F.count("deff").alias("known"), F.sum(F.expr("(1 - q) * deff")).alias("trace"))
    told = {r["kind"]: r for r in margins.collect()}
    n_rows, n_cols = (told[k]["n"] if k in told else 0 for k in ("row", "column"))
    if min(n_rows, n_cols) < 2:
        raise Refusal("weighted_crosstab: needs at least two categories in each column")
    if max_cells is not None and n_rows * n_cols > max_cells:
        raise Refusal(f"weighted_crosstab: more than {max_cells} cells; collapse the categories first")
    dof = (n_rows - 1) * (n_cols - 1)
    joined = of("cell").join(of("row").select("r", F.col("q").alias("qr")), "r").join(
        of("column").select("c", F.col("q").alias("qc")), "c")
    # cells without a row add their expected share
    x2, expected = joined.agg(F.sum(F.expr("power(q - qr * qc, 2) / (qr * qc)")), F.sum(F.expr("qr * qc"))).first()
    full = told["cell"]["n"] == n_rows * n_cols
    x2 += 0.0 if full else max(0.0, 1.0 - expected)
    factor = None
    if full and all(r["known"] == r["n"] for r in told.values()):
        factor = (told["cell"]["trace"] - told["row"]["trace"] - told["column"]["trace"]) / dof
    population = float(design.rows.agg(F.sum("w")).first()[0])
    uncorrected, naive = design.n * x2, population * x2
    corrected = uncorrected / factor if factor and factor > 0 else None
    v = (uncorrected / (design.n * (min(n_rows, n_cols) - 1))) ** 0.5
    return df.sparkSession.createDataFrame(
        [(corrected, dof, None if corrected is None else dist.chi2_upper(corrected, dof), factor, uncorrected,
          naive, design.n, population, v, design.dof)],
        "statistic double, dof int, p_value double, correction_factor double, uncorrected_statistic double, "
        "naive_statistic double, n long, estimated_population double, cramers_v double, design_dof int")


def rao_scott_factor(df, row, column, weights, strata=None, cluster=None, fpc=None, max_cells: int | None = None) -> DataFrame:
    return weighted_crosstab(df, row, column, weights, strata, cluster, fpc, max_cells).select("correction_factor")
