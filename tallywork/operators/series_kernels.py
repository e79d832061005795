"""Numeric kernels for one bounded series (at most 20 000 periods), run per key by Spark."""

from __future__ import annotations

import math

import numpy as np

from tallywork.functions.dist import f_upper, norm_upper, t_point

# ------------------------------------------------------------------------------ LOESS


def loess(y: np.ndarray, window: int, degree: int, at: np.ndarray | None = None) -> np.ndarray:
    """Tricube local fit of an evenly spaced sequence at positions ``at`` (may lie outside)."""
    n = y.size
    at = np.arange(n, dtype=float) if at is None else at.astype(float)
    q = min(window, n)
    left = np.clip(np.round(at).astype(int) - (q - 1) // 2, 0, n - q)
    near = left[:, None] + np.arange(q)[None, :]
    far = np.abs(near - at[:, None])
    reach = np.maximum(at - left, left + q - 1 - at)
    if window > n:
        reach = reach + (window - n) // 2
    reach = np.maximum(reach, 1e-12)[:, None]
    w = np.where(far <= 0.999 * reach, np.where(far <= 0.001 * reach, 1.0, (1 - (far / reach) ** 3) ** 3), 0.0)
    w = np.maximum(w, 0.0)
    w /= w.sum(axis=1, keepdims=True)
    values = y[near]
    level = (w * values).sum(axis=1)
    if degree == 0:
        return level
    centre = (w * near).sum(axis=1)
    spread = (w * (near - centre[:, None]) ** 2).sum(axis=1)
    slope = (w * (near - centre[:, None]) * values).sum(axis=1) / np.where(spread > 0, spread, 1.0)
    flat = np.sqrt(np.maximum(spread, 0)) <= 0.001 * (n - 1)
    return level + np.where(flat, 0.0, slope * (at - centre))


def _odd(x: float) -> int:
    whole = int(math.ceil(x))
    return whole if whole % 2 else whole + 1


def _mean(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.r_[0.0, x])
    return (total[width:] - total[:-width]) / width


def stl(y: np.ndarray, period: int, inner: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Trend and seasonal component; seasonal window of two cycles, degree 0."""
    n = y.size
    seasonal_window = max(7, 2 * period + 1)
    trend_window = max(3, _odd(1.5 * period / (1 - 1.5 / seasonal_window)))
    low_window = period + 1 if period % 2 == 0 else period + 2
    trend, seasonal = np.zeros(n), np.zeros(n)
    for _ in range(inner):
        free = y - trend
        cycles = np.zeros(n + 2 * period)
        for phase in range(period):
            part = free[phase::period]
            cycles[phase::period] = loess(part, seasonal_window, 0, np.arange(-1, part.size + 1))
        low = loess(_mean(_mean(_mean(cycles, period), period), 3), low_window, 1)
        seasonal = cycles[period:period + n] - low
        trend = loess(y - seasonal, trend_window, 1)
    return trend, seasonal


# ------------------------------------------------------------------------- regressions


def _least_squares(x: np.ndarray, y: np.ndarray):
    """Coefficients, residual sum, and (XᵀX)⁻¹."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ (x.T @ y)
    e = y - x @ beta
    return beta, float(e @ e), inverse


def _lags(x: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns x[t-1]..x[t-lags] for t from ``start``."""
    return np.column_stack([x[start - k: x.size - k] for k in range(1, lags + 1)]) if lags else np.empty((x.size - start, 0))


def partial_autocorrelations(r) -> list[float]:
    """Durbin-Levinson over autocorrelations r[0]=1, r[1], …"""
    r = np.asarray(r, dtype=float)
    out, phi, error = [], np.empty(0), 1.0
    for k in range(1, r.size):
        top = r[k] - (phi @ r[k - 1:0:-1] if k > 1 else 0.0)
        a = top / error if error else np.nan
        phi = np.r_[phi - a * phi[::-1], a]
        error *= 1 - a * a
        out.append(float(a))
    return out


# MacKinnon's response surface for one series (constant; constant and trend).
MACKINNON = {
    "c": dict(star=-1.61, low=-18.83, high=2.74, small=[2.1659, 1.4412, 0.038269],
              large=[1.7339, 0.93202, -0.12745, -0.010368]),
    "ct": dict(star=-2.89, low=-16.18, high=0.70, small=[3.2512, 1.6047, 0.049588],
               large=[2.5261, 0.61654, -0.37956, -0.060285]),
}
CRITICAL = {
    "c": [[-3.43035, -6.5393, -16.786, -79.433], [-2.86154, -2.8903, -4.234, -40.040],
          [-2.56677, -1.5384, -2.809, 0.0]],
    "ct": [[-3.95877, -9.0531, -28.428, -134.155], [-3.41049, -4.3904, -9.036, -45.374],
           [-3.12705, -2.5856, -3.925, -22.380]],
}
KPSS_TABLE = {"c": [0.347, 0.463, 0.574, 0.739], "ct": [0.119, 0.146, 0.176, 0.216]}
KPSS_P = [0.10, 0.05, 0.025, 0.01]


def mackinnon_p(statistic: float, regression: str) -> float:
    m = MACKINNON[regression]
    if statistic > m["high"]:
        return 1.0
    if statistic < m["low"]:
        return 1e-10
    terms = m["small"] if statistic <= m["star"] else m["large"]
    return max(1e-10, norm_upper(-sum(c * statistic**i for i, c in enumerate(terms))))


def adf(y: np.ndarray, regression: str = "c") -> dict:
    """Lag by AIC over a common sample, then the test on all rows that lag leaves."""
    n, fixed = y.size, 1 if regression == "c" else 2
    none = dict(statistic=None, p_value=None, lags_used=None, n_obs=None,
                critical_1=None, critical_5=None, critical_10=None)
    most = min(n // 2 - fixed - 1, int(math.ceil(12.0 * (n / 100.0) ** 0.25)))
    if most < 0 or np.ptp(y) == 0:
        return none
    d = np.diff(y)

    def fit(lags: int, start: int):
        rows = d.size - start
        trend = [np.ones(rows)] + ([np.arange(1, rows + 1, dtype=float)] if regression == "ct" else [])
        x = np.column_stack([y[start:-1], *trend, _lags(d, lags, start)])
        beta, rss, inverse = _least_squares(x, d[start:])
        return beta, rss, inverse, rows, x.shape[1]

    best = None
    for lags in range(most + 1):
        _, rss, _, rows, k = fit(lags, most)
        if rss <= 0:
            return none
        aic = rows * (math.log(2 * math.pi) + math.log(rss / rows) + 1) + 2 * k
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    beta, rss, inverse, rows, k = fit(lags, lags)
    if rows <= k or rss <= 0:
        return none
    statistic = float(beta[0] / math.sqrt(rss / (rows - k) * inverse[0, 0]))
    levels = [sum(c / rows**i for i, c in enumerate(row)) for row in CRITICAL[regression]]
    return dict(statistic=statistic, p_value=mackinnon_p(statistic, regression), lags_used=lags, n_obs=rows,
                critical_1=levels[0], critical_5=levels[1], critical_10=levels[2])


def kpss(y: np.ndarray, regression: str = "c") -> dict:
    n = y.size
    if regression == "c":
        e = y - y.mean()
    else:
        x = np.column_stack([np.ones(n), np.arange(n, dtype=float)])
        e = y - x @ _least_squares(x, y)[0]
    product = lambda k: float(e[k:] @ e[: n - k])
    s0, s1 = product(0) / n, 0.0
    if s0 <= 0:
        return dict(statistic=None, p_value=None, p_is_bound=None, lags_used=None)
    for i in range(1, int(n ** (2.0 / 9.0)) + 1):
        part = product(i) / (n / 2.0)
        s0 += part
        s1 += i * part
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = (product(0) + 2 * sum((1 - i / (lags + 1)) * product(i) for i in range(1, lags + 1))) / n
    statistic = float((np.cumsum(e) ** 2).sum() / n**2 / long_run)
    table = KPSS_TABLE[regression]
    p = float(np.interp(statistic, table, KPSS_P))
    return dict(statistic=statistic, p_value=p, p_is_bound=bool(statistic < table[0] or statistic > table[-1]),
                lags_used=lags)


def granger(y: np.ndarray, x: np.ndarray, max_lag: int) -> list[dict]:
    out = []
    for lag in range(1, max_lag + 1):
        own, other = _lags(y, lag, lag), _lags(x, lag, lag)
        ones, target = np.ones((own.shape[0], 1)), y[lag:]
        _, small, _ = _least_squares(np.hstack([ones, own]), target)
        full = np.hstack([ones, own, other])
        beta, big, inverse = _least_squares(full, target)
        dof = target.size - full.shape[1]
        f = (small - big) / lag / (big / dof) if dof > 0 and big > 0 else None
        total = float(beta[1 + lag:].sum())
        pick = np.r_[np.zeros(1 + lag), np.ones(lag)]
        var = float(pick @ inverse @ pick) * big / dof if dof > 0 else 0.0
        margin = t_point(0.975, dof) * math.sqrt(var) if var > 0 else None
        out.append(dict(
            lag=lag, f_statistic=f, df_num=lag, df_denom=dof, p_value=None if f is None else f_upper(f, lag, dof),
            partial_eta_squared=None if f is None else f * lag / (f * lag + dof), summed_coefficient=total,
            ci95_low=None if margin is None else total - margin, ci95_high=None if margin is None else total + margin))
    return out


# ------------------------------------------------------------------------------- ARIMA


def _polynomial(plain, seasonal, season: int, sign: float) -> np.ndarray:
    """Coefficients of (1 + sign Σ a Bⁱ)(1 + sign Σ A Bˢⁱ)."""
    a = np.r_[1.0, sign * np.asarray(plain)]
    b = np.zeros(len(seasonal) * max(season, 1) + 1)
    b[0] = 1.0
    for i, v in enumerate(seasonal, start=1):
        b[i * season] = sign * v
    return np.convolve(a, b)


def _residuals(w, params, order, seasonal, season, constant):
    p, _, q = order
    sp, _, sq = seasonal
    at = int(constant)
    ar = _polynomial(params[at:at + p], params[at + p + q:at + p + q + sp], season, -1.0)
    ma = _polynomial(params[at + p:at + p + q], params[at + p + q + sp:], season, 1.0)
    x = w - params[0] if constant else w
    u = np.convolve(x, ar)[: x.size]
    e = np.zeros(x.size)
    skip = ar.size - 1  # conditional: the first values only serve as lags
    if ma.size == 1:
        e[skip:] = u[skip:]
    else:
        back = ma[1:]
        for t in range(skip, x.size):
            m = min(t, back.size)
            e[t] = u[t] - (back[:m] @ e[t - m:t][::-1] if m else 0.0)
    return e[skip:], ar, ma


def arima(y, order, seasonal, season, horizon) -> list[dict]:
    """Conditional least squares by damped Gauss-Newton; intervals from the psi weights."""
    (p, d, q), (sp, sd, sq) = order, seasonal
    w, heads = y.copy(), []
    for _ in range(sd):
        heads.append(("s", w.copy()))
        w = w[season:] - w[:-season]
    for _ in range(d):
        heads.append(("d", w.copy()))
        w = np.diff(w)
    constant = d + sd == 0
    size = int(constant) + p + q + sp + sq
    params = np.zeros(size)
    if constant:
        params[0] = w.mean()
    run = lambda v: _residuals(w, v, order, seasonal, season, constant)[0]
    damp, e = 1e-3, run(params)
    for _ in range(100 if size else 0):
        jac = np.empty((e.size, size))
        for j in range(size):
            step = 1e-6 * max(1.0, abs(params[j]))
            moved = params.copy()
            moved[j] += step
            jac[:, j] = (run(moved) - e) / step
        a, g = jac.T @ jac, jac.T @ e
        improved = False
        for _ in range(12):
            trial = params - np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), g, rcond=None)[0]
            if np.all(np.abs(trial[int(constant):]) < 2.0):
                te = run(trial)
                if np.all(np.isfinite(te)) and te @ te < e @ e:
                    improved = True
                    break
            damp *= 10
        if not improved:
            break
        done = np.abs(trial - params).max() < 1e-8 * (1 + np.abs(params).max())
        params, e, damp = trial, te, damp / 10
        if done:
            break
    resid, ar, ma = _residuals(w, params, order, seasonal, season, constant)
    m = resid.size
    rss = float(resid @ resid)
    sigma2 = rss / max(1, m - size)
    like = -m / 2 * (math.log(2 * math.pi) + math.log(max(rss / m, 1e-300)) + 1)
    k = size + 1
    # forecast the differenced series, then undo the differences
    x = list(w - params[0] if constant else w)
    noise = list(np.r_[np.zeros(len(x) - m), resid])
    for _ in range(horizon):
        value = -sum(ar[i] * x[-i] for i in range(1, ar.size) if i <= len(x))
        value += sum(ma[i] * noise[-i] for i in range(1, ma.size) if i <= len(noise))
        x.append(value)
        noise.append(0.0)
    path = np.array(x[-horizon:]) + (params[0] if constant else 0.0)
    for kind, before in reversed(heads):
        known = list(before)
        for v in path:
            known.append(v + (known[-1] if kind == "d" else known[-season]))
        path = np.array(known[-horizon:])
    full = ar
    for kind, _ in heads:
        full = np.convolve(full, [1.0, -1.0] if kind == "d" else np.r_[1.0, np.zeros(season - 1), -1.0])
    psi = np.zeros(horizon)
    for j in range(horizon):
        psi[j] = ma[j] if j < ma.size else 0.0
        psi[j] -= sum(full[i] * psi[j - i] for i in range(1, min(j, full.size - 1) + 1))
    half = 1.959963984540054 * np.sqrt(sigma2 * np.cumsum(psi**2))
    shared = dict(coefficients=[float(v) for v in params], sigma2=sigma2, aic=-2 * like + 2 * k,
                  bic=-2 * like + math.log(m) * k)
    return [dict(step=j + 1, forecast=float(path[j]), low=float(path[j] - half[j]), high=float(path[j] + half[j]), **shared)
            for j in range(horizon)]
