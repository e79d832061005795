"""Row-local cleaning on a stream: the same steps, as projections and filters.

Steps that need a statistic of the whole column or the row order are refused, because a
stream has neither.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywork.errors import Refusal
from tallywork.operators.cleaning import STEPS, Run

ROW_LOCAL = {
    "clean_column_names", "rename_column", "strip_whitespace", "remove_currency_symbols",
    "extract_number", "convert_number_words", "convert_time_to_number", "free_to_zero",
    "remove_vague_entries", "sum_composite_expenses", "cap_extreme_values", "drop_null",
    "drop_incomplete_responses", "standardize_values", "flag_contextual_fraud",
}


def _row_local(step: dict) -> bool:
    name, params = step["operation"], step.get("params") or {}
    if name == "fill_null":
        return not params.get("strategy")
    if name == "cast_type":
        return params.get("target_type") != "int"
    return name in ROW_LOCAL


def clean_stream(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply row-local steps to a batch or streaming frame."""
    run = Run.start(df)
    for step in steps:
        if not _row_local(step):
            raise Refusal(f"step '{step['operation']}' looks at the whole table; run it on a batch")
        STEPS[step["operation"]](run, step.get("column"), **(step.get("params") or {}))
    return run.cleaned()
