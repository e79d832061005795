"""Row terms of the likelihood models and the climb to the maximum that all of them share.

The negative binomial needs differences lgamma(y + r) - lgamma(r) and their first two
derivatives. Both arguments are moved up by ``SHIFT`` with the recurrence, where the
asymptotic series is exact to the last digits, and the leading parts are subtracted by hand:
nothing cancels when r is huge, and the cost of a row does not grow with its count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, functions as F

SHIFT = 8
MAX_PASSES = 60
# coefficients of z^-1, z^-3, .. in lgamma, from the Bernoulli numbers B2, B4, ..
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)


def _tail(z: Column, order: int) -> Column:
    """The falling part of lgamma (0), digamma (1) or trigamma (2) beyond the leading terms."""
    out = F.lit(0.0)
    for i, b in enumerate(BERNOULLI, start=1):
        power = 2 * i - 1 + order
        scale = {0: b / (2 * i * (2 * i - 1)), 1: -b / (2 * i), 2: b}[order]
        out = out + F.lit(scale) * F.pow(z, F.lit(float(-power)))
    return out


def _steps(f) -> Column:
    out = f(0)
    for j in range(1, SHIFT):
        out = out + f(j)
    return out


def lgamma_rise(y: Column, r: Column) -> Column:
    """lgamma(y + r) - lgamma(r) for y >= 0, r > 0."""
    a, b = r + F.lit(float(SHIFT)), r + y + F.lit(float(SHIFT))
    high = (a - 0.5) * F.log1p(y / a) + y * F.log(b) - y + _tail(b, 0) - _tail(a, 0)
    return high - _steps(lambda j: F.log1p(y / (r + F.lit(float(j)))))


def digamma_rise(y: Column, r: Column) -> Column:
    a, b = r + F.lit(float(SHIFT)), r + y + F.lit(float(SHIFT))
    high = F.log1p(y / a) + y / (2 * a * b) + _tail(b, 1) - _tail(a, 1)
    return high + _steps(lambda j: y / ((r + F.lit(float(j))) * (r + y + F.lit(float(j)))))


def trigamma_rise(y: Column, r: Column) -> Column:
    a, b = r + F.lit(float(SHIFT)), r + y + F.lit(float(SHIFT))
    high = -y / (a * b) + 1 / (2 * b * b) - 1 / (2 * a * a) + _tail(b, 2) - _tail(a, 2)

    def step(j):
        low, up = r + F.lit(float(j)), r + y + F.lit(float(j))
        return 1 / (up * up) - 1 / (low * low)

    return high + _steps(step)


def logit_pieces(y: Column, eta: Column) -> dict[str, Column]:
    mu = 1 / (1 + F.exp(-eta))
    # log(1 + exp(eta)) without overflow
    soft = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
    return dict(score=y - mu, info=mu * (1 - mu), fisher=mu * (1 - mu), like=y * eta - soft)


def poisson_pieces(y: Column, eta: Column) -> dict[str, Column]:
    """Without the constant sum of log y!. ``eta`` includes the offset."""
    mu = F.exp(eta)
    return dict(score=y - mu, info=mu, fisher=mu, like=y * eta - mu)


def negative_binomial_pieces(y: Column, eta: Column, theta: Column) -> dict[str, Column]:
    """NB2 with theta = log alpha, r = 1 / alpha: score and observed information in both, the
    expected information of the coefficients, log likelihood without the sum of log y!."""
    r, mu = F.exp(-theta), F.exp(eta)
    whole = r + mu
    slope = digamma_rise(y, r) - F.log1p(mu / r) + (mu - y) / whole
    curve = trigamma_rise(y, r) + 1 / r - 2 / whole + (r + y) / (whole * whole)
    return dict(
        score=r * (y - mu) / whole, info=r * mu * (r + y) / (whole * whole), fisher=r * mu / whole,
        like=lgamma_rise(y, r) - r * F.log1p(mu / r) + y * (eta - F.log(whole)),
        theta_score=-r * slope, theta_info=-(r * r * curve + r * slope),
        cross=r * mu * (y - mu) / (whole * whole))


def sums(pieces: dict[str, Column], x: list[Column]) -> dict[str, Column]:
    """The sums that one pass must bring for ``advance``; ``unpack`` reads them."""
    p = len(x)
    out = {"like": F.sum(pieces["like"])}
    out |= {f"s{i}": F.sum(pieces["score"] * x[i]) for i in range(p)}
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out |= {f"i{i}_{j}": F.sum(pieces["info"] * x[i] * x[j]) for i, j in pairs}
    if "theta_score" in pieces:
        out |= {f"f{i}_{j}": F.sum(pieces["fisher"] * x[i] * x[j]) for i, j in pairs}
        out |= {f"c{i}": F.sum(pieces["cross"] * x[i]) for i in range(p)}
        out |= {"ts": F.sum(pieces["theta_score"]), "ti": F.sum(pieces["theta_info"])}
    return out


def unpack(got: dict[str, float], p: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, score, observed information, and an information that is safe far out."""
    square = lambda name: np.array(
        [[got[f"{name}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    score, info = np.array([got[f"s{i}"] for i in range(p)], dtype=float), square("i")
    if "ts" not in got:
        return got["like"], score, info, info
    safe, full = np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1))
    full[:p, :p], safe[:p, :p] = info, square("f")
    full[p, :p] = full[:p, p] = [got[f"c{i}"] for i in range(p)]
    full[p, p], safe[p, p] = got["ti"], abs(got["ti"])
    return got["like"], np.append(score, got["ts"]), full, safe


@dataclass
class Climb:
    """A point, the step that is tried from it, and how the search stands."""

    at: np.ndarray
    step: np.ndarray
    like: float = -math.inf
    state: str = "moving"  # moving, done, lost
    cov: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    passes: int = 0

    @property
    def tried(self) -> np.ndarray:
        return self.at + self.step


def start(at) -> Climb:
    at = np.asarray(at, dtype=float)
    return Climb(at, np.zeros(len(at)))


def _solve(info: np.ndarray, score: np.ndarray) -> np.ndarray | None:
    """Newton step where the information is positive definite, else nothing."""
    d = np.sqrt(np.abs(np.diag(info)))
    if not np.all(np.isfinite(info)) or not np.all(d > 0):
        return None
    try:
        np.linalg.cholesky(info / np.outer(d, d))
    except np.linalg.LinAlgError:
        return None
    return np.linalg.solve(info / np.outer(d, d), score / d) / d


def advance(climb: Climb, like, score, info, safe, longest: float = 5.0) -> Climb:
    """Next state after a pass at ``climb.tried``: a worse point halves the step, a better one
    gives a Newton step (scoring step where the likelihood bends the wrong way)."""
    passes = climb.passes + 1
    slack = 1e-11 * max(1.0, abs(like)) if like is not None and math.isfinite(like) else 0.0
    if like is None or not math.isfinite(like) or like < climb.like - slack:
        lost = passes >= MAX_PASSES or np.abs(climb.step).max() < 1e-10
        return Climb(climb.at, climb.step / 2, climb.like, "lost" if lost else "moving", passes=passes)
    at = climb.tried
    step = _solve(info, score)
    newton = step is not None
    if not newton:
        step = _solve(safe, score)
    if step is None or not np.all(np.isfinite(step)) or passes >= MAX_PASSES:
        return Climb(at, np.zeros(len(at)), like, "lost", passes=passes)
    if newton and (float(score @ step) < 1e-14 * max(1.0, abs(like)) or np.abs(step).max() < 1e-9):
        return Climb(at, np.zeros(len(at)), like, "done", np.linalg.inv(info), passes)
    return Climb(at, step * min(1.0, longest / np.abs(step).max()), like, "moving", passes=passes)
