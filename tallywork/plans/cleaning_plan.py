"""Ordered cleaning steps: a step that fails is recorded and skipped."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from tallywork.operators.cleaning import STEPS, Run
from tallywork.operators.outliers import Policy


@dataclass
class Cleaned:
    df: DataFrame
    audit: DataFrame
    failed: list[dict]


def run_cleaning(
    df: DataFrame, steps: list[dict], rid: str, policy: Policy | None = None
) -> Cleaned:
    """Fold ``{operation, column, params}`` steps over the frame.

    Row-local steps only add projections, so a run of them is one pass over the data;
    a step that needs a statistic reads it with its own aggregation first.
    """
    run, failed = Run.start(df, rid, policy), []
    for index, step in enumerate(steps):
        name, column = step.get("operation", ""), step.get("column")
        before = (run.df, run.rid, list(run.notes), run.dropped)
        try:
            if name not in STEPS:
                raise ValueError(f"Unknown operation '{name}'")
            STEPS[name](run, column, **(step.get("params") or {}))
        except (ValueError, TypeError, PySparkException, Py4JError) as exc:
            run.df, run.rid, run.notes, run.dropped = before
            failed.append(
                {"step_index": index, "operation": name, "column": column, "error": str(exc)}
            )
    return Cleaned(run.cleaned(), run.audit(), failed)
