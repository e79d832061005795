"""One regression per segment, all segments in the same jobs.

A segment's fit equals the fit of its rows alone: its own complete rows, its own reference
levels (dummies of all levels are summed, each segment keeps those it has), its own centring.
Every pass is one aggregation by segment, combined before the shuffle, so that a segment that
holds most rows costs one row per task. What comes out is one row of sums per segment; the
small systems are solved in tasks, never on the driver. Parameters go back to the rows by a
join without a hint. Likelihood models repeat this for the segments that still move.

Rows without a segment value form a segment of their own. A segment that cannot be fitted has
nulls and the reason in the summary, and no rows among the coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallywork.errors import Refusal, need_columns
from tallywork.functions.cells import dtype_of, is_date, is_number, number, quoted
from tallywork.operators import likelihood
from tallywork.operators.gram import Terms, level_names, variance_inflation
from tallywork.operators.regression import (
    LEAST_ALPHA, PERFECT_FIT, ROBUST, SEPARATED, SEPARATED_ERROR, _coefficients, count_figures, logit_figures, ols_report,
)
from tallywork.session import cut_lineage

FLAT = 1e-12  # spread over size below which a regressor counts as constant


@dataclass
class Segments:
    """Coefficients and summaries of all segments, as frames that start with the segment columns."""

    coefficients: DataFrame
    summary: DataFrame


@dataclass
class _Design:
    """Encoded rows: segment keys g0.., ``y``, extras, terms c0..; all but the keys are null in
    rows that are not complete. ``slots`` says what a term is: (regressor, level or none)."""

    rows: DataFrame
    by: list[str]
    slots: list[tuple[str, str | None]]

    @property
    def keys(self) -> list[str]:
        return [f"g{i}" for i in range(len(self.by))]

    @property
    def k(self) -> int:
        return len(self.slots)

    def named(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(g).alias(b) for g, b in zip(self.keys, self.by)],
                         *[c for c in df.columns if c not in self.keys])

    def schema(self, *fields: str) -> T.StructType:
        own = [T.StructField(g, self.rows.schema[g].dataType) for g in self.keys]
        return T.StructType(own + list(T.StructType.fromDDL(", ".join(fields)).fields))


def _design(df, y: Column, x, by, extra=None, raw=None) -> _Design:
    """``extra`` adds needed columns, ``raw`` columns kept as they are in every row."""
    extra, raw = extra or {}, raw or {}
    need_columns(df, [*x, *by])
    if not by:
        raise Refusal("name at least one segment column")
    if len(set(x)) < len(x) or not x:
        raise Refusal("regressors must be given once each")
    if set(x) & set(by):
        raise Refusal(f"{sorted(set(x) & set(by))} cannot be a segment and a regressor")
    numeric = [c for c in x if is_number(dtype_of(df, c))]
    for c in x:
        if is_date(dtype_of(df, c)):
            raise Refusal(f"regressor '{c}' is a date; derive a number from it first")
    base = df.select(
        *[quoted(c).alias(f"g{i}") for i, c in enumerate(by)], y.alias("y"),
        *[e.alias(n) for n, e in {**extra, **raw}.items()],
        *[(number(quoted(c)) if c in numeric else quoted(c).cast("string")).alias(f"x{i}") for i, c in enumerate(x)])
    slots, terms = [], []
    for i, c in enumerate(x):
        if c in numeric:
            slots.append((c, None))
            terms.append(F.col(f"x{i}"))
        else:
            for level in level_names(base.where(F.col("y").isNotNull()), f"x{i}", c):
                slots.append((c, level))
                terms.append((F.col(f"x{i}") == F.lit(level)).cast("double"))
    needed = ["y", *extra, *[f"x{i}" for i in range(len(x))]]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])
    held = lambda c: F.when(complete, c)
    rows = base.select(
        *[f"g{i}" for i in range(len(by))], *raw, *[held(F.col(c)).alias(c) for c in ("y", *extra)],
        *[held(c).alias(f"c{i}") for i, c in enumerate(terms)])
    return _Design(rows, list(by), slots)


def _moments(d: _Design, more: dict[str, Column]) -> DataFrame:
    """Per segment: rows, complete rows, means and the covariances of terms and outcome."""
    cols = [F.col(f"c{i}") for i in range(d.k)] + [F.col("y")]
    return d.rows.groupBy(*d.keys).agg(
        F.count("*").alias("n_rows"), F.count("y").alias("n"),
        F.array(*[F.avg(c) for c in cols]).alias("mean"),
        F.array(*[F.covar_samp(a, b) for i, a in enumerate(cols) for b in cols[i:]]).alias("cov"),
        *[v.alias(n) for n, v in more.items()])


def _picked(slots, n: int, mean: np.ndarray, cov: np.ndarray) -> tuple[list[int], str | None]:
    """Terms of a segment (its first level of each text column left out), or why it has no fit."""
    if n < 2:
        return [], f"{n} usable row(s)"
    use, seen = [], {}
    for i, (column, level) in enumerate(slots):
        if level is None:
            if not math.sqrt(max(cov[i, i], 0.0)) > FLAT * max(1.0, abs(mean[i])):
                return [], f"regressor '{column}' is constant, so it carries no information"
            use.append(i)
        else:
            seen.setdefault(column, [])
            if mean[i] > 0:
                seen[column].append(i)
    for column, found in seen.items():
        if len(found) < 2:
            return [], f"regressor '{column}' has a single value, so it carries no information"
        use += found[1:]
    use.sort()
    if n <= len(use) + 1:
        return [], f"{n} usable row(s) for {len(use) + 1} model parameters"
    sd = np.sqrt(np.diag(cov)[use])
    if np.linalg.eigvalsh(cov[np.ix_(use, use)] / np.outer(sd, sd))[0] < 1e-10:
        return [], "the regressors are collinear: one is a combination of the others"
    return use, None


def _square(flat, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = np.asarray(flat, dtype=float)
    return out + np.triu(out, 1).T


def _name(slot) -> str:
    return slot[0] if slot[1] is None else f"{slot[0]}[{slot[1]}]"


def _light(slots, use, mean, scale, n, n_excluded) -> Terms:
    return Terms(None, [_name(slots[i]) for i in use], np.asarray(mean)[use], 1 / np.asarray(scale)[use],
                 n, n_excluded, {})


def _map(df: DataFrame, make, schema: T.StructType) -> DataFrame:
    """Apply ``make`` (a row as a dict -> rows as dicts) in tasks; numbers that are not finite
    become null."""
    arrow = to_arrow_schema(schema)

    def plain(v):
        if isinstance(v, np.generic):
            v = v.item()
        return None if isinstance(v, float) and not math.isfinite(v) else v

    def run(batches):
        for batch in batches:
            out = [{n: plain(one.get(n)) for n in schema.names} for row in batch.to_pylist() for one in make(row)]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, schema)


def _attach(d: _Design, fits: DataFrame, names: list[str]) -> DataFrame:
    """Complete rows with the fit of their segment."""
    small = fits.select(*[F.col(g).alias(f"_{g}") for g in d.keys], *names)
    return d.rows.where("y IS NOT NULL").join(
        small, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in d.keys]).drop(*[f"_{g}" for g in d.keys])


def _centred(d: _Design) -> list[Column]:
    """Terms on the segment's own scale; a term the segment leaves out is zero (scale 0)."""
    return [((F.col(f"c{i}") - F.col("mean")[i]) * F.col("scale")[i]).alias(f"z{i}") for i in range(d.k)]


def _linear(d: _Design, beta: str) -> Column:
    out = F.col(beta)[0]
    for i in range(d.k):
        out = out + F.col(beta)[i + 1] * F.col(f"z{i}")
    return out


def _spread(values, use, k: int) -> list[float]:
    """Intercept and used terms placed among all terms."""
    out = np.zeros(k + 1)
    out[0] = values[0]
    out[[i + 1 for i in use]] = values[1:]
    return out.tolist()


def _scales(use, cov, k: int) -> list[float]:
    out = np.zeros(k)
    out[use] = 1 / np.sqrt(np.diag(cov)[use])
    return out.tolist()


def _report(d: _Design, fitted: DataFrame, make, kinds: dict[str, str], ratio: str | None) -> Segments:
    """``make(row)`` gives coefficient rows and the summary of a segment that has a fit."""
    keys = d.keys
    fitted = cut_lineage(fitted)
    columns = ["coefficient", "std_error", "statistic", "p_value", "ci95_low", "ci95_high"]
    columns += [ratio, f"{ratio}_low", f"{ratio}_high"] if ratio else []
    coef_schema = d.schema("term STRING", *[f"{c} DOUBLE" for c in columns])
    sum_schema = d.schema(*[f"{n} {k}" for n, k in kinds.items()], "reason STRING")

    def coefficients(row):
        if row["reason"] is not None:
            return []
        got, summary = make(row)
        return [] if isinstance(summary, str) else [{g: row[g] for g in keys} | r for r in got]

    def summaries(row):
        own = {g: row[g] for g in keys} | {"n": row["n"], "n_excluded": row["n_rows"] - row["n"]}
        if row["reason"] is not None:
            return [own | {"reason": row["reason"]}]
        _, summary = make(row)
        return [own | ({"reason": summary} if isinstance(summary, str) else summary)]

    return Segments(d.named(_map(fitted, coefficients, coef_schema)), d.named(_map(fitted, summaries, sum_schema)))


# --------------------------------------------------------------------------------- ols


OLS_KINDS = {
    "n": "BIGINT", "n_excluded": "BIGINT", "r_squared": "DOUBLE", "adj_r_squared": "DOUBLE",
    "f_statistic": "DOUBLE", "f_p_value": "DOUBLE", "dof_model": "BIGINT", "dof_resid": "BIGINT", "rmse": "DOUBLE",
    "aic": "DOUBLE", "bic": "DOUBLE", "breusch_pagan": "DOUBLE", "breusch_pagan_p": "DOUBLE",
    "jarque_bera": "DOUBLE", "jarque_bera_p": "DOUBLE", "influential_share": "DOUBLE", "max_cook": "DOUBLE",
    "max_vif": "DOUBLE"}


def ols_by(df: DataFrame, y: str, x: list[str], by: list[str], robust: str = "HC3") -> Segments:
    """Least squares in each segment: one pass for the cross products, one over the residuals."""
    if robust not in ROBUST:
        raise Refusal(f"Unknown standard errors: {robust}. Supported: {ROBUST}")
    need_columns(df, [y])
    if y in x or y in by:
        raise Refusal(f"the outcome '{y}' has another role too")
    d = _design(df, number(quoted(y)), x, by)
    k, slots, keys = d.k, d.slots, d.keys
    schema = d.schema(
        "n_rows BIGINT", "n BIGINT", "mean ARRAY<DOUBLE>", "cov ARRAY<DOUBLE>", "scale ARRAY<DOUBLE>",
        "beta ARRAY<DOUBLE>", "inverse ARRAY<DOUBLE>", "s2 DOUBLE", "params BIGINT", "reason STRING")

    def solve(row):
        n, mean = row["n"], np.asarray(row["mean"], dtype=float)
        cov = _square(row["cov"], k + 1)
        out = {g: row[g] for g in keys} | {c: row[c] for c in ("n_rows", "n", "mean", "cov")}
        use, reason = _picked(slots, n, mean, cov)
        if reason is None and not cov[k, k] > 0:
            reason = f"ols: the outcome '{y}' is constant"
        if reason is not None:
            return [out | {"reason": reason}]
        gram, scale = _gram(n, cov, use), _scales(use, cov, k)
        sd = np.sqrt(np.diag(cov)[use])
        beta = np.linalg.solve(gram, np.append(n * mean[k], (n - 1) * cov[use, k] / sd))
        inverse = np.linalg.inv(gram)
        spread = np.zeros((k + 1, k + 1))
        spots = [0, *[i + 1 for i in use]]
        spread[np.ix_(spots, spots)] = inverse
        rss = (n - 1) * (cov[k, k] - float(beta[1:] @ (cov[use, k] / sd)))
        if 1 - rss / ((n - 1) * cov[k, k]) > PERFECT_FIT:
            return [out | {"reason": "ols: the fit is perfect; the outcome is a combination of the regressors"}]
        return [out | dict(scale=scale, beta=_spread(beta, use, k), inverse=spread.ravel().tolist(),
                           s2=rss / (n - len(use) - 1), params=len(use) + 1, reason=None)]

    fits = cut_lineage(_map(_moments(d, {}), solve, schema))
    joined = _attach(d, fits.where("reason IS NULL"), ["mean", "scale", "beta", "inverse", "s2", "params", "n"])
    z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(k)]]
    h = F.lit(0.0)
    for i in range(k + 1):
        for j in range(i, k + 1):
            h = h + F.lit(1.0 if i == j else 2.0) * F.col("inverse")[i * (k + 1) + j] * z[i] * z[j]
    e2, lev = F.col("e") * F.col("e"), 1 - F.col("h")
    weight = {"none": e2, "HC0": e2, "HC1": e2, "HC2": e2 / lev, "HC3": e2 / (lev * lev)}[robust]
    cook = e2 / F.col("params") * F.col("h") / (lev * lev)
    rows = joined.select("*", *_centred(d)).withColumn("e", F.col("y") - _linear(d, "beta")).withColumn("h", h)
    found = rows.groupBy(*keys).agg(
        F.array(*[F.sum(weight * z[i] * z[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("meat"),
        F.array(*[F.sum(e2 * c) for c in z]).alias("bent"),
        F.sum(e2).alias("rss"), F.sum(e2 * e2).alias("e4"), F.skewness("e").alias("skew"),
        F.kurtosis("e").alias("kurt"), F.max(cook).alias("cook"),
        F.count_if(cook / F.col("s2") > 4.0 / F.col("n")).alias("influential"))
    out = _with_sums(d, fits, found)

    def make(row):
        n, mean, cov = int(row["n"]), np.asarray(row["mean"], dtype=float), _square(row["cov"], k + 1)
        use, _ = _picked(slots, n, mean, cov)
        spots = [0, *[i + 1 for i in use]]
        beta = np.asarray(row["beta"], dtype=float)[spots]
        meat = _square(row["meat"], k + 1)[np.ix_(spots, spots)]
        if robust == "HC1":
            meat = meat * n / (n - len(spots))
        s2 = row["rss"] / (n - len(spots))
        sums = dict(bent=np.asarray(row["bent"], dtype=float)[spots], e4=row["e4"], skew=row["skew"],
                    kurt=row["kurt"], influential=row["influential"], max_cook=row["cook"] / s2)
        gram = _gram(n, cov, use)
        errors, summary = ols_report(robust, n, beta, gram, meat, (n - 1) * cov[k, k], row["rss"], sums)
        terms = _light(slots, use, mean, row["scale"], n, row["n_rows"] - n)
        return _coefficients(terms, beta, errors, n - len(spots)), summary

    return _report(d, out, make, OLS_KINDS, None)


def _gram(n: int, cov: np.ndarray, use: list[int]) -> np.ndarray:
    """Cross products of intercept and standardized terms."""
    sd = np.sqrt(np.diag(cov)[use])
    out = np.zeros((len(use) + 1, len(use) + 1))
    out[0, 0] = n
    out[1:, 1:] = (n - 1) * cov[np.ix_(use, use)] / np.outer(sd, sd)
    return out


def _with_sums(d: _Design, fits: DataFrame, found: DataFrame) -> DataFrame:
    """One row per segment: its state and what a pass over its rows brought (null if none)."""
    right = found.select(*[F.col(g).alias(f"_{g}") for g in d.keys],
                         *[c for c in found.columns if c not in d.keys])
    return fits.join(right, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in d.keys], "left").drop(
        *[f"_{g}" for g in d.keys])


# ------------------------------------------------------------------- likelihood models


STATE = ("n_rows BIGINT", "n BIGINT", "mean ARRAY<DOUBLE>", "cov ARRAY<DOUBLE>", "scale ARRAY<DOUBLE>",
         "use ARRAY<BIGINT>", "level DOUBLE", "beta ARRAY<DOUBLE>", "theta DOUBLE", "at ARRAY<DOUBLE>",
         "step ARRAY<DOUBLE>", "like DOUBLE", "state STRING", "inverse ARRAY<DOUBLE>", "passes BIGINT",
         "null_like DOUBLE", "reason STRING")
KEPT = ("n_rows", "n", "mean", "cov", "scale", "use", "level", "null_like")
PIECES = {"logit": likelihood.logit_pieces, "poisson": likelihood.poisson_pieces,
          "negative_binomial": likelihood.negative_binomial_pieces}


def _placed(climb: likelihood.Climb, use, k: int, joint: bool) -> dict:
    """State of a climb as fields; ``beta`` and ``theta`` are the point to try next."""
    point = climb.tried
    beta = point[:-1] if joint else point
    return dict(at=climb.at.tolist(), step=climb.step.tolist(), state=climb.state, passes=climb.passes,
                like=climb.like if math.isfinite(climb.like) else None, inverse=climb.cov.ravel().tolist(),
                beta=_spread(beta, use, k), theta=float(point[-1]) if joint else None)


def _begin(d: _Design, moments: DataFrame, check, joint: bool) -> DataFrame:
    """First state of every segment. ``check(row)`` gives the intercept to start from, or why
    the segment has no fit."""
    k, slots, keys = d.k, d.slots, d.keys

    def make(row):
        n, mean, cov = row["n"], np.asarray(row["mean"], dtype=float), _square(row["cov"], k + 1)
        out = {g: row[g] for g in keys} | {c: row[c] for c in ("n_rows", "n", "mean", "cov")}
        use, reason = _picked(slots, n, mean, cov)
        level = check(row) if reason is None else None
        if isinstance(level, str) or reason is not None:
            return [out | {"reason": reason or level}]
        first = [level] + [0.0] * len(use)
        if joint:
            first.append(math.log(min(max((cov[k, k] - mean[k]) / mean[k] ** 2, 0.01), 10.0)))
        climb = likelihood.start(first)
        return [out | dict(scale=_scales(use, cov, k), use=use, level=level) | _placed(climb, use, k, joint)]

    return cut_lineage(_map(moments, make, d.schema(*STATE)))


def _climb(d: _Design, fits: DataFrame, family: str, what: str, offset: Column, bare: bool = False) -> DataFrame:
    """Passes over the rows of the segments that still move, until none does. ``bare`` fits the
    intercept (and the dispersion) only and leaves the maximum in ``null_like``."""
    joint, keys, k = family == "negative_binomial", d.keys, d.k
    z = [F.lit(1.0), *([] if bare else [F.col(f"z{i}") for i in range(k)])]
    size, names = len(z), []

    def make(row):
        if row["reason"] is not None or row["state"] != "moving":
            return [{c: v for c, v in row.items() if c != "sums"}]
        own = {c: row[c] for c in (*keys, *KEPT)}
        use = [] if bare else row["use"]
        like = -math.inf if row["like"] is None else row["like"]
        climb = likelihood.Climb(np.array(row["at"]), np.array(row["step"]), like, "moving", passes=row["passes"])
        got = dict(zip(names, row["sums"]))
        if any(v is None or not math.isfinite(v) for v in got.values()):
            got = dict.fromkeys(names, 0.0) | {"like": None}
        spots = [0, *[i + 1 for i in use], *([size] if joint else [])]
        value, score, info, safe = likelihood.unpack(got, size)
        cut = np.ix_(spots, spots)
        climb = likelihood.advance(climb, value, score[spots], info[cut], safe[cut], 2.0 if joint else 5.0)
        out = own | _placed(climb, use, k, joint)
        if family == "logit" and got.get("margin", 0.0) > 0:  # every row on its own side: no maximum exists
            return [out | {"reason": SEPARATED}]
        if joint and climb.tried[-1] < math.log(LEAST_ALPHA):
            return [out | {"reason": "count_model: no extra dispersion to estimate; use the Poisson family"}]
        return [out | {"reason": f"{what}: the fit does not converge" if climb.state == "lost" else None}]

    while not (moving := fits.where("reason IS NULL AND state = 'moving'")).isEmpty():
        rows = _attach(d, moving, ["mean", "scale", "beta", "theta"])
        rows = rows.select("*", *_centred(d)).withColumn(
            "_eta", offset + (F.col("beta")[0] if bare else _linear(d, "beta")))
        arguments = [F.col("y"), F.col("_eta"), *([F.col("theta")] if joint else [])]
        pieces = PIECES[family](*arguments)
        sums = likelihood.sums({c: F.col(f"_{c}") for c in pieces}, z)
        if family == "logit":
            pieces["margin"] = (2 * F.col("y") - 1) * F.col("_eta")
            sums["margin"] = F.min("_margin")
        names[:] = list(sums)
        found = rows.select(*keys, *[f"z{i}" for i in range(k)], *[v.alias(f"_{c}") for c, v in pieces.items()]).groupBy(
            *keys).agg(F.array(*sums.values()).alias("sums"))
        fits = cut_lineage(_map(_with_sums(d, fits, found), make, d.schema(*STATE)))
    return fits


def _solved(row, k: int, joint: bool):
    """Used terms, estimates and their covariance (log alpha last, if it was fitted)."""
    at = np.array(row["at"], dtype=float)
    return row["use"], at, np.array(row["inverse"], dtype=float).reshape(len(at), len(at))


LOGIT_KINDS = {
    "n": "BIGINT", "n_excluded": "BIGINT", "successes": "BIGINT", "base_rate": "DOUBLE", "log_likelihood": "DOUBLE",
    "null_log_likelihood": "DOUBLE", "pseudo_r_squared": "DOUBLE", "llr_statistic": "DOUBLE", "llr_p_value": "DOUBLE",
    "aic": "DOUBLE", "bic": "DOUBLE", "events_per_predictor": "DOUBLE", "events_ok": "BOOLEAN"}


def logit_by(df: DataFrame, y: str, x: list[str], success_value, by: list[str], robust: str = "none") -> Segments:
    """Maximum-likelihood log-odds in each segment."""
    need_columns(df, [y])
    if y in x or y in by:
        raise Refusal(f"the outcome '{y}' has another role too")
    value = quoted(y).cast("string")
    d = _design(df, (value == F.lit(str(success_value))).cast("double"), x, by, raw={"_other": F.when(
        value != F.lit(str(success_value)), value)})
    k, slots = d.k, d.slots
    d.rows = d.rows.persist()
    try:
        moments = _moments(d, {"low": F.min("_other"), "high": F.max("_other")})

        def check(row):
            base = row["mean"][k]
            if not 0 < base < 1:
                return f"logit: {success_value!r} never or always occurs in '{y}'"
            return math.log(base / (1 - base)) if row["low"] == row["high"] else f"logit: '{y}' needs exactly two values"

        fits = _climb(d, _begin(d, moments, check, False), "logit", "logit", F.lit(0.0))
        if robust != "none":
            rows = _attach(d, fits.where("reason IS NULL"), ["mean", "scale", "beta"]).select("*", *_centred(d))
            z = [F.lit(1.0), *[F.col(f"z{i}") for i in range(k)]]
            score = likelihood.logit_pieces(F.col("y"), _linear(d, "beta"))["score"]
            found = rows.withColumn("_w", F.pow(score, F.lit(2.0))).groupBy(*d.keys).agg(
                F.array(*[F.sum(F.col("_w") * z[i] * z[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("meat"))
            fits = _with_sums(d, fits, found)

        def make(row):
            use, beta, cov = _solved(row, k, False)
            if robust != "none":
                spots = [0, *[i + 1 for i in use]]
                cov = cov @ _square(row["meat"], k + 1)[np.ix_(spots, spots)] @ cov
            terms = _light(slots, use, row["mean"], row["scale"], row["n"], row["n_rows"] - row["n"])
            rows = _coefficients(terms, beta, cov, ratio="odds_ratio")
            if max(r["std_error"] for r in rows) > SEPARATED_ERROR:
                return [], SEPARATED
            return rows, logit_figures(row["n"], len(use), row["mean"][k], row["like"])

        return _report(d, fits, make, LOGIT_KINDS, "odds_ratio")
    finally:
        d.rows.unpersist()


COUNT_KINDS = {
    "n": "BIGINT", "n_excluded": "BIGINT", "mean_outcome": "DOUBLE", "variance_outcome": "DOUBLE",
    "log_likelihood": "DOUBLE", "null_log_likelihood": "DOUBLE", "pseudo_r_squared": "DOUBLE", "aic": "DOUBLE",
    "bic": "DOUBLE", "pearson_chi2": "DOUBLE", "dof_resid": "BIGINT", "dispersion": "DOUBLE", "dispersion_p": "DOUBLE",
    "dispersion_ok": "BOOLEAN"}


def count_model_by(
    df: DataFrame, y: str, x: list[str], by: list[str], family: str = "poisson", exposure: str | None = None,
) -> Segments:
    """Poisson or negative binomial rates in each segment."""
    if family not in ("poisson", "negative_binomial"):
        raise Refusal(f"count_model: unknown family {family!r}")
    need_columns(df, [y, *([exposure] if exposure else [])])
    roles = [y, *x, *by, *([exposure] if exposure else [])]
    if len(set(roles)) < len(roles):
        raise Refusal(f"columns of the model have one role each: {roles}")
    joint = family == "negative_binomial"
    extra = {"_exposure": number(quoted(exposure))} if exposure else {}
    d = _design(df, number(quoted(y)), x, by, extra)
    k, slots = d.k, d.slots
    offset = F.log("_exposure") if exposure else F.lit(0.0)
    amount = F.col("_exposure") if exposure else F.when(F.col("y").isNotNull(), F.lit(1.0))

    def check(row):
        if row["least"] < 0:
            return f"count_model: '{y}' contains negative values"
        if exposure and row["low"] <= 0:
            return f"count_model: exposure '{exposure}' has non-positive values"
        return math.log(row["total"] / row["amount"]) if row["total"] else "count_model: every count is zero"

    d.rows = d.rows.persist()
    try:
        moments = _moments(d, {"least": F.min("y"), "low": F.min(amount), "total": F.sum("y"), "amount": F.sum(amount)})
        fits = _begin(d, moments, check, joint)
        if joint:
            fits = _climb(d, _bare(fits), family, "count_model", offset, bare=True)
            fits = cut_lineage(_map(fits, lambda row: _from_null(row, k), d.schema(*STATE)))
        fits = _climb(d, fits, family, "count_model", offset)
        rows = _attach(d, fits.where("reason IS NULL"), ["mean", "scale", "beta", "theta", "level"]).select("*", *_centred(d))
        mu = F.exp(_linear(d, "beta") + offset)
        spread = F.col("_mu") * (1 + F.exp("theta") * F.col("_mu")) if joint else F.col("_mu")
        flat = F.col("level") + offset
        found = rows.withColumn("_mu", mu).groupBy(*d.keys).agg(
            F.sum(F.pow(F.col("y") - F.col("_mu"), F.lit(2.0)) / spread).alias("chi2"),
            F.sum(F.col("y") * flat - F.exp(flat)).alias("flat"),
            F.sum(likelihood.lgamma_rise(F.col("y"), F.lit(1.0))).alias("constant"))

        def make(row):
            use, at, cov = _solved(row, k, joint)
            n, size = row["n"], len(use) + 1
            null = row["null_like"] if joint else row["flat"]
            terms = _light(slots, use, row["mean"], row["scale"], n, row["n_rows"] - n)
            figures = count_figures(n, len(use), row["like"] - row["constant"], null - row["constant"], row["chi2"], int(joint))
            if joint:
                alpha = math.exp(at[-1])
                figures |= dict(alpha=alpha, alpha_se=alpha * math.sqrt(cov[-1, -1]))
            figures |= dict(mean_outcome=row["mean"][k], variance_outcome=_square(row["cov"], k + 1)[k, k])
            return _coefficients(terms, at[:size], cov[:size, :size], ratio="irr"), figures

        kinds = COUNT_KINDS | ({"alpha": "DOUBLE", "alpha_se": "DOUBLE"} if joint else {})
        return _report(d, _with_sums(d, fits, found), make, kinds, "irr")
    finally:
        d.rows.unpersist()


def _bare(fits: DataFrame) -> DataFrame:
    """Start of the fit without terms: intercept and log alpha of the full start."""
    ends = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)[0], F.element_at(c, -1)))
    return fits.withColumns({"at": ends("at"), "step": ends("step")})


def _from_null(row: dict, k: int) -> list[dict]:
    """Start of the full fit from the maximum without terms."""
    if row["reason"] is not None:
        return [row]
    level, theta = row["at"]
    climb = likelihood.start([level, *[0.0] * len(row["use"]), theta])
    return [row | _placed(climb, row["use"], k, True) | {"null_like": row["like"]}]
