"""Linear, logistic, count and quantile regression with their diagnostics."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tallywork.errors import Refusal, need_columns
from tallywork.functions import dist
from tallywork.functions.cells import number, quoted
from tallywork.operators import likelihood
from tallywork.operators.gram import (
    INTERCEPT, Terms, check_rank, cross_products, design_matrix, variance_inflation,
)
from tallywork.operators.ordering import exact_quantiles, previous_row

ROBUST = ("none", "HC0", "HC1", "HC2", "HC3")
PERFECT_FIT = 1 - 1e-9
LEAST_ALPHA = 1e-8
SEPARATED_ERROR = 25.0
SEPARATED = "logit: the outcome is separated by the regressors, so no estimate exists"


@dataclass
class Fit:
    """Coefficient table and a one-row summary, both as frames."""

    coefficients: DataFrame
    summary: DataFrame
    terms: Terms
    beta: np.ndarray  # standardized, intercept first


def _frame(spark, rows: list[dict]) -> DataFrame:
    names = list(rows[0])
    kinds = {
        c: "string" if any(isinstance(r[c], str) for r in rows)
        else "boolean" if all(isinstance(r[c], bool) or r[c] is None for r in rows) and any(r[c] is not None for r in rows)
        else "long" if all(isinstance(r[c], int) for r in rows) else "double"
        for c in names
    }
    clean = lambda v, kind: None if v is None or (isinstance(v, float) and not math.isfinite(v)) else (
        float(v) if kind == "double" else v)
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items())
    return spark.createDataFrame([tuple(clean(r[c], kinds[c]) for c in names) for r in rows], schema)


def _coefficients(terms: Terms, beta, cov, dof=None, ratio: str | None = None) -> list[dict]:
    """Original-scale estimates with t (given dof) or z statistics."""
    a = terms.unscale()
    b, se = a @ beta, np.sqrt(np.maximum(np.diag(a @ cov @ a.T), 0.0))
    point = dist.t_point(0.975, dof) if dof else dist.norm_point(0.975)
    rows = []
    for name, value, error in zip([INTERCEPT, *terms.names], b, se):
        stat = value / error if error > 0 else None
        p = None if stat is None else (
            dist.t_two_tail(stat, dof) if dof else 2 * dist.norm_upper(abs(stat)))
        row = dict(term=name, coefficient=float(value), std_error=float(error),
                   statistic=None if stat is None else float(stat), p_value=p,
                   ci95_low=float(value - point * error), ci95_high=float(value + point * error))
        if ratio:
            grown = [math.exp(min(v, 700.0)) for v in (row["coefficient"], row["ci95_low"], row["ci95_high"])]
            row |= {ratio: grown[0], f"{ratio}_low": grown[1], f"{ratio}_high": grown[2]}
        rows.append(row)
    return rows


# --------------------------------------------------------------------------------- ols


def ols(df: DataFrame, y: str, x: list[str], robust: str = "HC3", rid: str | None = None) -> Fit:
    """Least squares: one pass for scale, one for cross products, one over the residuals.

    The residual pass carries everything that needs e and the leverage h at once: the robust
    middle matrix, Breusch-Pagan's regression of e², the residual shape and Cook's distances.
    """
    if robust not in ROBUST:
        raise Refusal(f"Unknown standard errors: {robust}. Supported: {ROBUST}")
    terms = design_matrix(df, y, x, carry=[rid] if rid else [])
    rows = terms.rows
    gram, xty = cross_products(terms)
    check_rank(gram, terms.names)
    inverse = np.linalg.inv(gram)
    beta = np.linalg.solve(gram, xty)
    n, p = terms.n, terms.k + 1
    dof = n - p
    mean_y = xty[0] / n
    first = rows.select(F.pow(F.col("y") - F.lit(float(mean_y)), 2).alias("d"),
                        F.pow(F.col("y") - terms.linear(beta), 2).alias("e2")).agg(
        F.sum("d").alias("tss"), F.sum("e2").alias("rss")).first()
    tss, rss = first["tss"], first["rss"]
    r2 = 1 - rss / tss if tss > 0 else None
    if r2 is None:
        raise Refusal(f"ols: the outcome '{y}' is constant")
    if r2 > PERFECT_FIT:
        raise Refusal("ols: the fit is perfect; the outcome is a combination of the regressors")
    s2 = rss / dof
    z = [F.lit(1.0), *terms.z]
    h = F.lit(0.0)
    for i in range(p):
        for j in range(i, p):
            h = h + F.lit(float(inverse[i, j] * (1 if i == j else 2))) * z[i] * z[j]
    e2, lev = F.col("e") * F.col("e"), 1 - F.col("h")
    weight = {"none": F.lit(s2), "HC0": e2, "HC1": e2 * F.lit(n / dof), "HC2": e2 / lev,
              "HC3": e2 / (lev * lev)}[robust]
    cook = e2 / F.lit(p * s2) * F.col("h") / (lev * lev)
    aggs = {f"m{i}_{j}": F.sum(weight * z[i] * z[j]) for i in range(p) for j in range(i, p)}
    aggs |= {f"b{i}": F.sum(e2 * z[i]) for i in range(p)}
    aggs |= {"e4": F.sum(e2 * e2), "skew": F.skewness("e"), "kurt": F.kurtosis("e"),
             "influential": F.count_if(cook > F.lit(4.0 / n)), "max_cook": F.max(cook)}
    fitted = rows.withColumn("e", F.col("y") - terms.linear(beta)).withColumn("h", h)
    got = fitted.agg(*[v.alias(k) for k, v in aggs.items()]).first()
    meat = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    sums = dict(bent=np.array([got[f"b{i}"] for i in range(p)]), **{
        c: got[c] for c in ("e4", "skew", "kurt", "influential", "max_cook")})
    cov, summary = ols_report(robust, n, beta, gram, meat, tss, rss, sums)
    summary = dict(n=n, n_excluded=terms.n_excluded, **summary)
    spark = df.sparkSession
    return Fit(_frame(spark, _coefficients(terms, beta, cov, dof)), _frame(spark, [summary]), terms, beta)


def ols_report(robust: str, n: int, beta, gram, meat, tss: float, rss: float, sums: dict):
    """Covariance of the coefficients and the summary figures, from sums over the rows."""
    inverse, p = np.linalg.inv(gram), len(beta)
    dof, q = n - p, p - 1
    s2, r2 = rss / dof, 1 - rss / tss
    if robust == "none":
        cov = inverse * s2
        f_stat = (tss - rss) / q / s2
    else:
        cov = inverse @ meat @ inverse
        f_stat = float(beta[1:] @ np.linalg.solve(cov[1:, 1:], beta[1:])) / q
    bent = sums["bent"]
    bp_tss = sums["e4"] - bent[0] ** 2 / n
    bp_ess = float(bent @ inverse @ bent) - bent[0] ** 2 / n
    bp = n * bp_ess / bp_tss if bp_tss > 0 else None
    jb = n / 6 * (sums["skew"] ** 2 + sums["kurt"] ** 2 / 4)
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    return cov, dict(
        r_squared=r2, adj_r_squared=1 - (1 - r2) * (n - 1) / dof,
        f_statistic=f_stat, f_p_value=dist.f_upper(f_stat, q, dof), dof_model=q, dof_resid=dof,
        rmse=math.sqrt(s2), aic=-2 * llf + 2 * p, bic=-2 * llf + math.log(n) * p,
        breusch_pagan=bp, breusch_pagan_p=None if bp is None else dist.chi2_upper(bp, q),
        jarque_bera=jb, jarque_bera_p=dist.chi2_upper(jb, 2),
        influential_share=sums["influential"] / n, max_cook=sums["max_cook"],
        max_vif=float(variance_inflation(gram).max()))


def vif(df: DataFrame, x: list[str]) -> DataFrame:
    """Variance inflation per term; above 10 the term is nearly a combination of others."""
    terms = design_matrix(df, F.lit(0.0), x)
    gram, _ = cross_products(terms)
    check_rank(gram, terms.names)
    return _frame(df.sparkSession, [
        dict(term=t, vif=float(v), ok=bool(v <= 10.0)) for t, v in zip(terms.names, variance_inflation(gram))])


def breusch_pagan(df, y, x) -> DataFrame:
    return ols(df, y, x).summary.selectExpr(
        "breusch_pagan AS statistic", "dof_model AS dof", "breusch_pagan_p AS p_value",
        "breusch_pagan_p >= 0.05 AS passed")


def jarque_bera(df, y, x) -> DataFrame:
    return ols(df, y, x).summary.selectExpr(
        "jarque_bera AS statistic", "jarque_bera_p AS p_value", "jarque_bera_p >= 0.05 AS passed")


def cooks_distance(df, y, x) -> DataFrame:
    """Share of rows above 4/n; fails past ten per cent."""
    return ols(df, y, x).summary.selectExpr(
        "influential_share", "max_cook", "influential_share <= 0.10 AS passed")


def durbin_watson(df, y, x, rid: str) -> DataFrame:
    """Serial correlation of the residuals in row order; the row before may sit in the range
    before, so the last row of each range is carried over."""
    need_columns(df, [rid])
    fit = ols(df, y, x, rid=rid)
    e = fit.terms.rows.select(quoted(rid).alias("_at"), (F.col("y") - fit.terms.linear(fit.beta)).alias("e"))
    steps = previous_row(e, "_at", {"e": "before"})
    return steps.agg(
        (F.sum(F.expr("power(e - before, 2)")) / F.sum(F.expr("e * e"))).alias("statistic")
    ).withColumn("passed", F.expr("statistic BETWEEN 1.5 AND 2.5"))


# ------------------------------------------------------------------- likelihood models


def _newton(terms: Terms, eta_pieces, start: np.ndarray, what: str, max_iter: int = 50):
    """Newton steps; ``eta_pieces(eta)`` gives score weight, information weight and log
    likelihood as columns. Each step is one aggregation over the encoded rows."""
    beta, p = start, terms.k + 1
    x = [F.lit(1.0), *terms.z]
    for _ in range(max_iter):
        score, info, like = eta_pieces(terms.linear(beta))
        rows = terms.rows.withColumn("_s", score).withColumn("_i", info).withColumn("_l", like)
        aggs = {f"s{i}": F.sum(F.col("_s") * x[i]) for i in range(p)}
        aggs |= {f"g{i}_{j}": F.sum(F.col("_i") * x[i] * x[j]) for i in range(p) for j in range(i, p)}
        got = rows.agg(F.sum("_l").alias("like"), *[v.alias(k) for k, v in aggs.items()]).first()
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        s = np.array([got[f"s{i}"] for i in range(p)])
        try:
            step = np.linalg.solve(gram, s)
        except np.linalg.LinAlgError:
            raise Refusal(f"{what}: the fit does not converge")
        if not np.all(np.isfinite(step)):
            raise Refusal(f"{what}: the fit does not converge")
        if float(s @ step) < 1e-14 * max(1.0, abs(got["like"])) or np.abs(step).max() < 1e-9:
            return beta, np.linalg.inv(gram), got["like"]
        beta = beta + step * min(1.0, 5.0 / np.abs(step).max())
    raise Refusal(f"{what}: the fit does not converge")


def logit(df: DataFrame, y: str, x: list[str], success_value, robust: str = "none") -> Fit:
    """Maximum-likelihood log-odds; a separated outcome is refused."""
    need_columns(df, [y])
    if y in x:
        raise Refusal(f"the outcome '{y}' cannot also be a regressor")
    hit = (quoted(y).cast("string") == F.lit(str(success_value))).cast("double")
    terms = design_matrix(df, hit, x)
    check_rank(cross_products(terms)[0], terms.names)
    if df.select(y).dropna().distinct().limit(3).count() != 2:
        raise Refusal(f"logit: '{y}' needs exactly two values")
    base = terms.rows.agg(F.avg("y")).first()[0]
    if not 0 < base < 1:
        raise Refusal(f"logit: {success_value!r} never or always occurs in '{y}'")
    n, k = terms.n, terms.k

    def pieces(eta):
        got = likelihood.logit_pieces(F.col("y"), eta)
        return got["score"], got["info"], got["like"]

    terms.rows = terms.rows.persist()
    try:
        start = np.zeros(k + 1)
        start[0] = math.log(base / (1 - base))
        beta, cov, like = _newton(terms, pieces, start, "logit")
        if robust != "none":
            gram, _ = cross_products(terms, weight=F.pow(pieces(terms.linear(beta))[0], 2))
            cov = cov @ gram @ cov
    finally:
        terms.rows.unpersist()
    rows = _coefficients(terms, beta, cov, ratio="odds_ratio")
    if max(r["std_error"] for r in rows) > SEPARATED_ERROR:
        raise Refusal(SEPARATED)
    summary = dict(n=n, n_excluded=terms.n_excluded, **logit_figures(n, k, base, like))
    spark = df.sparkSession
    return Fit(_frame(spark, rows), _frame(spark, [summary]), terms, beta)


def logit_figures(n: int, k: int, base: float, like: float) -> dict:
    null = n * (base * math.log(base) + (1 - base) * math.log(1 - base))
    lr = 2 * (like - null)
    events = int(round(min(base, 1 - base) * n))
    return dict(
        successes=int(round(base * n)), base_rate=base,
        log_likelihood=like, null_log_likelihood=null, pseudo_r_squared=1 - like / null,
        llr_statistic=lr, llr_p_value=dist.chi2_upper(lr, k), aic=-2 * like + 2 * (k + 1),
        bic=-2 * like + math.log(n) * (k + 1), events_per_predictor=events / k,
        events_ok=bool(events / k >= 10.0))


def events_per_predictor(df, y, x, success_value) -> DataFrame:
    """Rows of the rarer class per model term; at least ten are wanted."""
    hit = (quoted(y).cast("string") == F.lit(str(success_value))).cast("double")
    terms = design_matrix(df, hit, x)
    return terms.rows.agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("successes")).withColumn(
        "events_per_predictor", F.expr(f"least(successes, n - successes) / {terms.k}")
    ).withColumn("passed", F.expr("events_per_predictor >= 10"))


def _count_terms(df, y, x, exposure) -> Terms:
    if exposure and (exposure == y or exposure in x):
        raise Refusal(f"'{exposure}' already has a role in the model")
    extra = {"_exposure": number(quoted(exposure))} if exposure else {}
    terms = design_matrix(df, y, x, extra=extra)
    low = terms.rows.agg(F.min("y"), F.min("_exposure") if exposure else F.lit(1.0)).first()
    if low[0] < 0:
        raise Refusal(f"count_model: '{y}' contains negative values")
    if exposure and low[1] <= 0:
        raise Refusal(f"count_model: exposure '{exposure}' has non-positive values")
    check_rank(cross_products(terms)[0], terms.names)
    return terms


def count_model(df: DataFrame, y: str, x: list[str], family: str = "poisson", exposure: str | None = None) -> Fit:
    if family not in ("poisson", "negative_binomial"):
        raise Refusal(f"count_model: unknown family {family!r}")
    terms = _count_terms(df, y, x, exposure)
    terms.rows = terms.rows.persist()
    try:
        return (_poisson if family == "poisson" else _negative_binomial)(df, terms, bool(exposure))
    finally:
        terms.rows.unpersist()


def _offset(exposed: bool):
    return F.log("_exposure") if exposed else F.lit(0.0)


def _count_start(terms, exposed) -> np.ndarray:
    total = terms.rows.agg(F.sum("y"), F.sum(F.exp(_offset(exposed)))).first()
    if not total[0]:
        raise Refusal("count_model: every count is zero")
    start = np.zeros(terms.k + 1)
    start[0] = math.log(total[0] / total[1])
    return start


def _log_factorial():
    return likelihood.lgamma_rise(F.col("y"), F.lit(1.0))


def _poisson(df, terms: Terms, exposed: bool) -> Fit:
    offset = _offset(exposed)

    def pieces(eta):
        got = likelihood.poisson_pieces(F.col("y"), eta + offset)
        return got["score"], got["info"], got["like"]

    start = _count_start(terms, exposed)
    beta, cov, like = _newton(terms, pieces, start, "count_model")
    mu0 = F.exp(F.lit(float(start[0])) + offset)
    mu = F.exp(terms.linear(beta) + offset)
    got = terms.rows.agg(
        F.sum(F.pow(F.col("y") - mu, 2) / mu).alias("chi2"),
        F.sum(F.col("y") * F.log(mu0) - mu0).alias("null"),
        F.sum(_log_factorial()).alias("constant"),
        F.avg("y").alias("mean"), F.var_samp("y").alias("var")).first()
    return _count_fit(df, terms, beta, cov, like - got["constant"], got["null"] - got["constant"], got, {}, 0)


def _count_fit(df, terms, beta, cov, like, null, got, more: dict, extra_params: int) -> Fit:
    summary = dict(
        n=terms.n, n_excluded=terms.n_excluded, mean_outcome=got["mean"], variance_outcome=got["var"],
        **count_figures(terms.n, terms.k, like, null, got["chi2"], extra_params), **more)
    spark = df.sparkSession
    return Fit(_frame(spark, _coefficients(terms, beta, cov, ratio="irr")), _frame(spark, [summary]), terms, beta)


def count_figures(n: int, k: int, like: float, null: float, chi2: float, extra_params: int) -> dict:
    dof = n - k - 1
    params = k + 1 + extra_params
    p = dist.chi2_upper(chi2, dof)
    return dict(
        log_likelihood=like, null_log_likelihood=null, pseudo_r_squared=1 - like / null,
        aic=-2 * like + 2 * params, bic=-2 * like + math.log(n) * params,
        pearson_chi2=chi2, dof_resid=dof, dispersion=chi2 / dof, dispersion_p=p, dispersion_ok=bool(p >= 0.05))


def dispersion_check(df, y, x, exposure=None) -> DataFrame:
    """Pearson chi-square over its degrees of freedom under the Poisson model."""
    return count_model(df, y, x, "poisson", exposure).summary.select(
        "pearson_chi2", "dof_resid", "dispersion", F.col("dispersion_p").alias("p_value"),
        F.col("dispersion_ok").alias("passed"))


def _joint_climb(terms: Terms, offset, start: np.ndarray) -> likelihood.Climb:
    """Coefficients and log alpha together, one aggregation a step."""
    x = [F.lit(1.0), *terms.z]
    climb = likelihood.start(start)
    while climb.state == "moving":
        point = climb.tried
        if point[-1] < math.log(LEAST_ALPHA):
            raise Refusal("count_model: no extra dispersion to estimate; use the Poisson family")
        pieces = likelihood.negative_binomial_pieces(
            F.col("y"), terms.linear(point[:-1]) + offset, F.lit(float(point[-1])))
        rows = terms.rows.select(*[v.alias(f"_{k}") for k, v in pieces.items()], *terms.z)
        aggs = likelihood.sums({k: F.col(f"_{k}") for k in pieces}, x)
        got = rows.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict()
        climb = likelihood.advance(climb, *likelihood.unpack(got, terms.k + 1), longest=2.0)
    if climb.state == "lost":
        raise Refusal("count_model: the fit does not converge")
    return climb


def _negative_binomial(df, terms: Terms, exposed: bool) -> Fit:
    """NB2 by joint Newton steps; errors from the joint second derivatives."""
    offset = _offset(exposed)
    start = np.append(_count_start(terms, exposed), 0.0)
    start[-1] = math.log(_first_alpha(terms, exposed, start[0]))
    bare = Terms(terms.rows, [], np.array([]), np.array([]), terms.n, 0, {})
    null = _joint_climb(bare, offset, start[[0, -1]])
    start[0], start[-1] = null.at
    full = _joint_climb(terms, offset, start)
    beta, alpha = full.at[:-1], math.exp(full.at[-1])
    mu = F.exp(terms.linear(beta) + offset)
    got = terms.rows.agg(
        F.avg("y").alias("mean"), F.var_samp("y").alias("var"), F.sum(_log_factorial()).alias("constant"),
        F.sum(F.pow(F.col("y") - mu, 2) / (mu * (1 + F.lit(alpha) * mu))).alias("chi2")).first()
    more = dict(alpha=alpha, alpha_se=alpha * math.sqrt(full.cov[-1, -1]))
    return _count_fit(df, terms, beta, full.cov[:-1, :-1], full.like - got["constant"],
                      null.like - got["constant"], got, more, 1)


def _first_alpha(terms: Terms, exposed: bool, level: float) -> float:
    """Moment estimate of the dispersion with no regressors, kept off the edge."""
    mu = F.exp(F.lit(float(level)) + _offset(exposed))
    got = terms.rows.agg(F.sum(F.pow(F.col("y") - mu, 2) - mu).alias("a"), F.sum(mu * mu).alias("b")).first()
    return min(max(got["a"] / got["b"], 0.01), 10.0)


# ---------------------------------------------------------------------------- quantile


def _hall_sheather(n: int, q: float) -> float:
    z = dist.norm_point(q)
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    ratio = 1.5 * density**2 / (2 * z * z + 1)
    return n ** (-1 / 3) * dist.norm_point(0.975) ** (2 / 3) * ratio ** (1 / 3)


MIDDLE_ROWS = 20_000  # rows near the quantile plane that one exact solve may hold


def _vertex(x, y, w, tau, beta, pull):
    """Exact minimum of the weighted check loss on a bounded set of rows, by moving from one
    fit through p points to the next. ``pull`` is the fixed slope of all other rows."""
    p = x.shape[1]
    basis, q = [], np.zeros((0, p))
    for i in np.argsort(np.abs(y - x @ beta), kind="stable"):
        left = x[i] - q.T @ (q @ x[i]) if len(basis) else x[i]
        if np.linalg.norm(left) > 1e-8 * (1 + np.linalg.norm(x[i])):
            basis.append(int(i))
            q = np.vstack([q, left / np.linalg.norm(left)])
            if len(basis) == p:
                break
    if len(basis) < p:
        return None
    for _ in range(20_000):
        inverse = np.linalg.inv(x[basis])
        beta = inverse @ y[basis]
        e = y - x @ beta
        tiny = 1e-11 * (1 + np.abs(y).max())
        e[np.abs(e) < tiny] = 0.0
        psi = w * np.where(e >= 0, tau, tau - 1.0)
        psi[basis] = 0.0
        slope = (psi @ x + pull) @ inverse
        up, down = w[basis] * (1 - tau) - slope, w[basis] * tau + slope
        j = int(np.argmin(np.minimum(up, down)))
        rate = min(up[j], down[j])
        if rate >= -1e-9 * (1 + np.abs(slope).max()):
            return beta
        step = x @ (inverse[:, j] if up[j] <= down[j] else -inverse[:, j])
        step[basis] = 0.0
        crossing = ((e > 0) & (step > 1e-14)) | ((e < 0) & (step < -1e-14)) | ((e == 0) & (step > 1e-14))
        at = np.flatnonzero(crossing)
        if not at.size:
            return None
        at = at[np.argsort(e[at] / step[at], kind="stable")]
        rates = rate + np.cumsum(w[at] * np.abs(step[at]))
        stop = int(np.searchsorted(rates, 0.0))
        basis[j] = int(at[min(stop, at.size - 1)])
    return beta


def _smooth_steps(terms: Terms, tau: float, beta, spread: float):
    """Newton on the logistic-smoothed check loss with a shrinking width, until few rows lie
    within the width; one aggregation per step."""
    x, p, width = [F.lit(1.0), *terms.z], terms.k + 1, spread / 2
    for _ in range(24):
        u = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("_e") / F.lit(width)))
        share = 1 / (1 + F.exp(u))  # smoothed indicator of a negative residual
        rows = terms.rows.withColumn("_e", F.col("y") - terms.linear(beta)).withColumn("_s", share)
        info = F.col("_s") * (1 - F.col("_s")) / F.lit(width)
        aggs = {f"s{i}": F.sum((F.lit(tau) - F.col("_s")) * x[i]) for i in range(p)}
        aggs |= {f"g{i}_{j}": F.sum(info * x[i] * x[j]) for i in range(p) for j in range(i, p)}
        got = rows.agg(F.count_if(F.abs("_e") <= width).alias("near"), *[v.alias(k) for k, v in aggs.items()]).first()
        gram = np.array([[got[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        step = np.linalg.lstsq(gram, np.array([got[f"s{i}"] for i in range(p)]), rcond=None)[0]
        beta = beta + step * min(1.0, 4 * width / max(np.abs(step).max(), 1e-300))
        if np.abs(step).max() < width / 4:
            if got["near"] <= MIDDLE_ROWS / 4:
                break
            width /= 4
    return beta


def _exact_quantile_fit(terms: Terms, tau: float, beta) -> np.ndarray:
    """Rows far above or below the plane keep their sign, so only their sums matter; the rows
    near it are solved exactly, and one pass checks that no far row changed its sign."""
    x, p, n = [F.lit(1.0), *terms.z], terms.k + 1, terms.n
    names, keep = [f"t{i}" for i in range(terms.k)], MIDDLE_ROWS
    for _ in range(12):
        e = F.col("y") - terms.linear(beta)
        rows = terms.rows.withColumn("_e", e)
        near = None
        if n > keep:
            near = exact_quantiles(rows, {"a": F.abs("_e")}, [keep / n])["a"][0]
        middle = rows if near is None else rows.where(F.abs("_e") <= F.lit(near))
        points = middle.groupBy("y", *names).agg(F.count("*").alias("w")).limit(8 * keep + 1).toPandas()
        if len(points) > 8 * keep:
            raise Refusal("quantile_regression: too many rows lie at one distance from the fit")
        pull = np.zeros(p)
        if near is not None:
            above, below = F.col("_e") > F.lit(near), F.col("_e") < F.lit(-near)
            psi = F.when(above, F.lit(tau)).when(below, F.lit(tau - 1.0)).otherwise(0.0)
            pull = np.array(list(rows.agg(*[F.sum(psi * c) for c in x]).first()))
        xs = np.column_stack([np.ones(len(points)), points[names].to_numpy(dtype=float)])
        new = _vertex(xs, points["y"].to_numpy(dtype=float), points["w"].to_numpy(dtype=float), tau, beta, pull)
        if new is None:
            raise Refusal("quantile_regression: the fit is not determined by the rows near it")
        if near is None:
            return new
        after = F.col("y") - terms.linear(new)
        crossed = rows.where(((F.col("_e") > near) & (after < 0)) | ((F.col("_e") < -near) & (after > 0)))
        if crossed.isEmpty():
            return new
        beta, keep = new, min(2 * keep, 8 * MIDDLE_ROWS)
    raise Refusal("quantile_regression: the fit does not settle")


def quantile_regression(df: DataFrame, y: str, x: list[str], tau: float = 0.5) -> Fit:
    """Exact fit of a conditional quantile: smoothed Newton passes bring the plane close, and
    an exact solve over the rows near it finishes. Sandwich errors use an Epanechnikov
    density at the Hall-Sheather bandwidth."""
    if not 0 < tau < 1:
        raise Refusal(f"quantile_regression: tau must be between 0 and 1, got {tau}")
    terms = design_matrix(df, y, x)
    n, p = terms.n, terms.k + 1
    if n * min(tau, 1 - tau) < 10 * p:
        raise Refusal("quantile_regression: too few rows beyond the quantile for this many terms")
    terms.rows = terms.rows.persist()
    try:
        gram, xty = cross_products(terms)
        check_rank(gram, terms.names)
        sd_y = terms.rows.agg(F.stddev_samp("y")).first()[0]
        beta = np.linalg.solve(gram, xty)
        e = F.col("y") - terms.linear(beta)
        beta[0] += exact_quantiles(terms.rows, {"e": e}, [tau])["e"][0]
        if n > MIDDLE_ROWS:
            spread = terms.rows.agg(F.stddev_samp(e)).first()[0]
            if spread > 0:
                beta = _smooth_steps(terms, tau, beta, spread)
        beta = _exact_quantile_fit(terms, tau, beta)
        rows = terms.rows.withColumn("e", F.col("y") - terms.linear(beta))
        e25, e75 = exact_quantiles(rows, {"e": F.col("e")}, [0.25, 0.75])["e"]
        base = exact_quantiles(rows, {"y": F.col("y")}, [tau])["y"][0]
        h = _hall_sheather(n, tau)
        width = min(sd_y, (e75 - e25) / 1.34) * (
            dist.norm_point(min(tau + h, 1 - 1e-12)) - dist.norm_point(max(tau - h, 1e-12)))
        u = F.col("e") / F.lit(float(width) if width > 0 else 1e-12)
        kernel = F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0)
        loss = lambda c: c * (F.lit(tau) - (c < 0).cast("double"))
        got = rows.agg(
            F.sum(kernel).alias("k"), F.sum(loss(F.col("e"))).alias("v"),
            F.sum(loss(F.col("y") - F.lit(base))).alias("v0"), F.avg((F.col("e") < 0).cast("double")).alias("below")
        ).first()
        inverse = np.linalg.inv(gram)
        density = got["k"] / (n * width) if width > 0 else 0.0
        if density > 0:
            d = F.when(F.col("y") - terms.linear(beta) > 0, F.lit((tau / density) ** 2)).otherwise(
                F.lit(((1 - tau) / density) ** 2))
            meat, _ = cross_products(terms, weight=d)
            cov = inverse @ meat @ inverse
        else:
            cov = np.zeros((p, p))
    finally:
        terms.rows.unpersist()
    summary = dict(
        n=n, n_excluded=terms.n_excluded, tau=tau, pseudo_r_squared=1 - got["v"] / got["v0"],
        share_below=got["below"], bandwidth=float(width), sparsity=1 / density if density > 0 else None)
    spark = df.sparkSession
    return Fit(_frame(spark, _coefficients(terms, beta, cov, n - p)), _frame(spark, [summary]), terms, beta)
