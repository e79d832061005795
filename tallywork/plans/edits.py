"""Ordered lists of table edits, run fail-fast, and their preview."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywork.errors import Refusal
from tallywork.operators import manipulate as m

EDITS = {
    "delete_columns": m.delete_columns,
    "rename_column": m.rename_column,
    "sort": m.sort,
    "filter_rows": m.filter_rows,
    "add_column": m.add_column,
    "merge_columns": m.merge_columns,
    "format_column": m.format_column,
    "move_column": m.move_column,
    "split_column": m.split_column,
    "drop_duplicates": m.drop_duplicates,
    "fill_nulls": m.fill_nulls,
    "cast_type": m.cast_type,
    "reorder_columns": m.reorder_columns,
}


ORDERED = {"sort", "drop_duplicates", "fill_nulls"}  # these look at the row order


def run_edits(df: DataFrame, edits: list[dict], rid: str | None = None) -> DataFrame:
    for number, edit in enumerate(edits, start=1):
        name = edit.get("op_type")
        if name not in EDITS:
            raise Refusal(f"Step {number}: unknown operation '{name}'")
        try:
            params = dict(edit.get("params") or {})
            if name in ORDERED and rid is not None:
                params.setdefault("rid", rid)
            df = df.transform(EDITS[name], **params)
        except (ValueError, TypeError) as exc:
            raise Refusal(f"Step {number} ({name}): {exc}") from exc
    return df


def preview_edits(df: DataFrame, edits: list[dict], rid: str | None = None, rows: int = 5) -> dict:
    """What the edits would do: sample rows, touched columns, row change, warnings."""
    after = run_edits(df, edits, rid)
    n_before, n_after = df.count(), after.count()
    added = [c for c in after.columns if c not in df.columns]
    removed = [c for c in df.columns if c not in after.columns]
    named = [
        e.get("params", {}).get("column") for e in edits
        if e.get("params", {}).get("column") in after.columns
    ]
    warnings = []
    if n_after < n_before:
        warnings.append(f"{n_before - n_after} row(s) will be removed")
    if removed:
        warnings.append(f"{len(removed)} column(s) will be removed: {', '.join(removed)}")
    lost = (n_before - n_after) / n_before if n_before else 0.0
    return {
        "before": df.limit(rows),
        "after": after.limit(rows),
        "affected_columns": sorted({*added, *removed, *named}),
        "rows_before": n_before,
        "rows_after": n_after,
        "row_change": n_after - n_before,
        "warnings": warnings,
        "needs_confirmation": lost > 0.10 or bool(removed),
    }
