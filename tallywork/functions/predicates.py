"""The ten row predicates shared by the analysis filter and the row filter step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywork.errors import Refusal, need_columns
from tallywork.functions.cells import dtype_of, number, quoted, text

ORDERING = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
OPERATORS = [*ORDERING, "==", "!=", "contains", "not_contains", "is_null", "is_not_null"]


def _as_number(value):
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def predicate(df: DataFrame, column: str, operator: str, value=None, strict: bool = True) -> Column:
    """Row test for ``where`` (null counts as no). ``strict`` refuses an ordering against a
    value that is not a number."""
    need_columns(df, [column])
    if operator not in OPERATORS:
        raise Refusal(f"Unknown operator: {operator}. Supported: {OPERATORS}")
    c = quoted(column)
    if operator == "is_null":
        return c.isNull()
    if operator == "is_not_null":
        return c.isNotNull()
    if operator in ("contains", "not_contains"):
        hit = F.coalesce(text(c).rlike("(?i)" + str(value)), F.lit(False))
        return hit if operator == "contains" else ~hit
    if operator == "==":
        return c == F.lit(value)
    if operator == "!=":
        return ~c.eqNullSafe(F.lit(value))
    limit = _as_number(value)
    if limit is None and strict:
        raise Refusal(f"Filter value {value!r} is not numeric for operator {operator!r}")
    if limit is None:
        return ORDERING[operator](c, F.lit(value))
    kind = dtype_of(df, column)
    if not isinstance(kind, T.NumericType):
        return ORDERING[operator](number(c), F.lit(limit))
    # a bare comparison reaches the Parquet scan; NaN sorts above every number
    hit = ORDERING[operator](c, F.lit(limit))
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    return hit & ~F.isnan(c) if floating and operator in (">", ">=") else hit
