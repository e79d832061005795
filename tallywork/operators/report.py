"""Bounded views of results for display, with their sizes and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from tallywork.functions.cells import is_date, quoted

ROWS_SHOWN = 200


def json_safe(df: DataFrame) -> DataFrame:
    """Dates as ISO text, NaN and infinities as null."""
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if is_date(f.dataType):
            iso = "yyyy-MM-dd" if isinstance(f.dataType, T.DateType) else "yyyy-MM-dd'T'HH:mm:ss"
            c = F.date_format(c, iso)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def result_table(df: DataFrame, limit: int = ROWS_SHOWN) -> DataFrame:
    """The first rows of a result for display; the result itself stays a lazy frame."""
    return json_safe(df).limit(limit)


def observed(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Observation]:
    """Complete rows, with n and n_excluded counted while the operator's own job runs."""
    seen = Observation()
    whole = F.lit(True)
    for c in needed:
        whole = whole & quoted(c).isNotNull()
    marked = df.observe(
        seen, F.count_if(whole).alias("n"), F.count_if(~whole).alias("n_excluded"))
    return marked.dropna(subset=needed), seen


def p_text(p) -> "F.Column":
    """A p-value for display: never rounded to zero, significant figures below 1e-4."""
    return F.when(p < 1e-4, F.format_string("%.3e", p)).otherwise(F.format_string("%.4f", p))
