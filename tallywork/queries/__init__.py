"""Registered queries: one per operator, with the same question in plain SQL beside it."""

from __future__ import annotations

from tallywork.queries.base import ORACLES, QUERIES


def load() -> None:
    from tallywork.queries import (  # noqa: F401
        bivariate, cleaning, combine, inference, profiling, regression, reporting, series, sources,
        survey, tables, verification,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
