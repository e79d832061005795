"""What changed between two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywork.functions.cells import dtype_of, is_number, number, quoted, text
from tallywork.operators.ordering import dense_ordinal


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns added, removed, kept, and kept with another type."""
    old, new = dict(before.dtypes), dict(after.dtypes)
    rows = []
    for c in sorted({*old, *new}):
        if c not in old:
            change = "added"
        elif c not in new:
            change = "removed"
        else:
            change = "kept" if old[c] == new[c] else "type changed"
        rows.append((c, change, old.get(c), new.get(c)))
    return before.sparkSession.createDataFrame(
        rows, "column string, change string, before_type string, after_type string")


def row_change(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.count(), after.count()
    return before.sparkSession.createDataFrame(
        [(a, b, max(0, b - a), max(0, a - b))],
        "rows_before long, rows_after long, rows_added long, rows_removed long")


def drift(before: DataFrame, after: DataFrame, min_pct: float = 5.0) -> DataFrame:
    """Numeric columns whose mean moved by more than five per cent: one pass per table."""
    shared = [
        c for c in sorted(set(before.columns) & set(after.columns))
        if is_number(dtype_of(before, c)) and is_number(dtype_of(after, c))
    ]

    def stats(df: DataFrame, side: str) -> DataFrame:
        one = F.array(*[
            F.struct(
                F.lit(c).alias("column"), F.avg(number(quoted(c))).alias(f"{side}_mean"),
                F.stddev_samp(number(quoted(c))).alias(f"{side}_std"),
                (F.avg(number(quoted(c)).isNull().cast("double")) * 100).alias(f"{side}_null_pct"))
            for c in shared
        ] or [F.struct(F.lit(None).cast("string").alias("column"))])
        return df.agg(one.alias("r")).select(F.explode("r").alias("r")).select("r.*")

    if not shared:
        return before.sparkSession.createDataFrame([], "column string, pct_change double")
    both = stats(before, "before").join(stats(after, "after"), "column").withColumn(
        "mean_shift", F.expr("after_mean - before_mean"))
    both = both.withColumn("pct_change", F.expr("coalesce(mean_shift / nullif(before_mean, 0) * 100, 0)"))
    return both.where(F.abs("pct_change") > min_pct)


def cell_changes(before: DataFrame, after: DataFrame, rid: str) -> DataFrame:
    """Cells that differ between rows at the same position, over the whole tables."""
    shared = [c for c in sorted(set(before.columns) & set(after.columns)) if c != rid]
    a = dense_ordinal(before, rid, "_at").select("_at", *[quoted(c).alias(f"_a{i}") for i, c in enumerate(shared)])
    b = dense_ordinal(after, rid, "_at").select("_at", *[quoted(c).alias(f"_b{i}") for i, c in enumerate(shared)])
    cells = F.array(*[
        F.struct(
            F.lit(c).alias("column"), text(F.col(f"_a{i}")).alias("before"), text(F.col(f"_b{i}")).alias("after"),
            (~F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))).alias("changed"))
        for i, c in enumerate(shared)
    ])
    joined = a.join(b, "_at").select(F.col("_at").alias("row"), F.inline(cells))
    return joined.where("changed").drop("changed")


def compare_frames(before: DataFrame, after: DataFrame, rid: str) -> dict[str, DataFrame]:
    return {
        "columns": column_changes(before, after),
        "rows": row_change(before, after),
        "drift": drift(before, after),
        "cells": cell_changes(before, after, rid),
    }
