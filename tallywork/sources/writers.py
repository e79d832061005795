"""Writers; text cells that a spreadsheet would run as a formula are made inert."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallywork.errors import need_columns
from tallywork.functions.cells import is_text, neutralised, quoted


def _subset(df: DataFrame, columns) -> DataFrame:
    if columns is None:
        return df
    need_columns(df, columns)
    return df.select(*[quoted(c) for c in columns])


def neutralize_formulas(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            neutralised(quoted(f.name)).alias(f.name) if is_text(f.dataType) else quoted(f.name)
            for f in df.schema
        ]
    )


def write_csv(df: DataFrame, path: str, columns=None) -> None:
    safe = neutralize_formulas(_subset(df, columns))
    safe.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, columns=None) -> None:
    """One record per line, so that the output stays splittable."""
    _subset(df, columns).write.mode("errorifexists").json(path)


def write_parquet(df: DataFrame, path: str, columns=None) -> None:
    _subset(df, columns).write.mode("errorifexists").parquet(path)
