"""Spreadsheet-style edits: each is a function ``(df, **params) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywork.errors import Refusal, need_columns
from tallywork.functions import cells
from tallywork.functions.cells import number, quoted, text
from tallywork.functions.predicates import predicate
from tallywork.operators.ordering import carry, exact_quantiles


def _replace(df: DataFrame, column: str, expr) -> DataFrame:
    return df.select(*[expr.alias(c) if c == column else quoted(c) for c in df.columns])


def delete_columns(df, columns):
    if not columns:
        raise Refusal("No columns specified for deletion")
    need_columns(df, columns)
    return df.drop(*columns)


def rename_column(df, old_name, new_name):
    if not old_name or not new_name:
        raise Refusal("Both old_name and new_name are required")
    need_columns(df, [old_name])
    if new_name in df.columns:
        raise Refusal(f"Column '{new_name}' already exists")
    return df.withColumnRenamed(old_name, new_name)


def sort(df, column, ascending=True, rid=None):
    """Nulls last both ways; ``rid`` keeps equal rows in file order."""
    if not column:
        raise Refusal("Column name required for sort")
    need_columns(df, [column])
    c = quoted(column)
    keys = [c.asc_nulls_last() if ascending else c.desc_nulls_last()]
    return df.orderBy(*keys, *([quoted(rid)] if rid else []))


def filter_rows(df, column, operator, value=None):
    if not column or not operator:
        raise Refusal("Column and operator are required for filtering")
    return df.where(predicate(df, column, operator, value, strict=False))


def _joined_text(columns, separator):
    parts = []
    for i, c in enumerate(columns):
        parts += ([F.lit(separator)] if i else []) + [text(quoted(c))]
    return F.concat(*parts)


def add_column(df, name, default_value=None, source_columns=(), operation="sum", separator=" "):
    if not name:
        raise Refusal("Column name is required")
    if name in df.columns:
        raise Refusal(f"Column '{name}' already exists")
    if len(source_columns) >= 2:
        need_columns(df, source_columns)
        if operation == "sum":
            total = F.lit(0.0)
            for c in source_columns:
                total = total + F.coalesce(number(quoted(c)), F.lit(0.0))
            return df.withColumn(name, total)
        if operation == "concat":
            return df.withColumn(name, _joined_text(source_columns, separator))
        raise Refusal(f"Unknown operation: {operation}")
    return df.withColumn(
        name, F.lit(default_value) if default_value is not None else F.lit(None).cast("string")
    )


def merge_columns(df, columns, new_name, separator=" ", drop_originals=False):
    if len(columns) < 2:
        raise Refusal("At least 2 columns required for merge")
    if not new_name:
        raise Refusal("new_name is required")
    need_columns(df, columns)
    merged = df.withColumn(new_name, _joined_text(columns, separator))
    return merged.drop(*[c for c in columns if c != new_name]) if drop_originals else merged


def format_column(df, column, format_type):
    need_columns(df, [column])
    c, x = quoted(column), number(quoted(column))
    money = F.concat(
        F.lit("$"), F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.format_number(F.abs(x), 2)
    )
    forms = {
        "currency": F.coalesce(money, F.lit("")),
        "percentage": F.coalesce(F.format_string("%.1f%%", x), F.lit("")),
        "integer": F.coalesce(
            F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("string"), F.lit("")
        ),
        "lowercase": F.lower(text(c)),
        "uppercase": F.upper(text(c)),
        "titlecase": cells.title_case(text(c)),
        "trim": cells.strip(text(c)),
    }
    # format_string prints a null argument as text
    forms["percentage"] = F.when(x.isNull(), "").otherwise(forms["percentage"])
    if format_type not in forms:
        raise Refusal(f"Unknown format_type: {format_type}")
    return _replace(df, column, forms[format_type])


def move_column(df, column, before=None, after=None, position=None):
    need_columns(df, [column])
    rest = [c for c in df.columns if c != column]
    if before in rest:
        at = rest.index(before)
    elif after in rest:
        at = rest.index(after) + 1
    elif position is not None:
        at = min(max(int(position), 0), len(rest))
    else:
        at = 0
    return df.select(*[quoted(c) for c in [*rest[:at], column, *rest[at:]]])


def split_column(df, column, delimiter=",", new_names=(), drop_original=False):
    """Pieces become columns; without names, as many as the longest cell needs."""
    need_columns(df, [column])
    pattern = delimiter if len(delimiter) > 1 else r"\Q" + delimiter + r"\E"  # longer is a regex
    pieces = F.split(text(quoted(column)), pattern)
    width = df.agg(F.max(F.size(pieces))).first()[0] or 0
    names = list(new_names)[:width] or [f"{column}_{i + 1}" for i in range(width)]
    split = df.withColumns({n: cells.strip(F.get(pieces, F.lit(i))) for i, n in enumerate(names)})
    return split.drop(column) if drop_original else split


def drop_duplicates(df, rid, columns=None, keep="first"):
    """One row per distinct key (null equals null); ``keep`` is first, last or False.

    Written as an aggregate, so that copies of a hot key collapse before the shuffle.
    """
    keys = list(columns or [c for c in df.columns if c != rid])
    need_columns(df, [*keys, rid])
    rest = [c for c in df.columns if c not in keys and c != rid]
    row = F.struct(quoted(rid).alias(rid), *[quoted(c).alias(c) for c in rest])
    pick = F.max(row) if keep == "last" else F.min(row)
    kept = df.groupBy(*[quoted(c) for c in keys]).agg(pick.alias("_row"), F.count("*").alias("_n"))
    if keep is False:
        kept = kept.where(F.col("_n") == 1)
    return kept.select(
        *[quoted(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def most_common(df, column):
    """Most frequent value, the smallest one on a tie."""
    counts = df.where(quoted(column).isNotNull()).groupBy(quoted(column).alias("v")).count()
    row = counts.orderBy(F.col("count").desc(), F.col("v")).first()
    return row["v"] if row else None


def fill_nulls(df, column, value=None, method=None, rid=None):
    need_columns(df, [column])
    c = quoted(column)
    if method in ("ffill", "bfill"):
        if rid is None:
            raise Refusal("ffill and bfill need the row-order column")
        return carry(df, rid, column, forward=method == "ffill")
    if method == "mean":
        fill = df.agg(F.avg(number(c))).first()[0]
    elif method == "median":
        fill = exact_quantiles(df, {"x": number(c)}, [0.5])["x"][0]
    elif method == "mode":
        fill = most_common(df, column)
    elif value is not None:
        fill = value
    else:
        raise Refusal("Either value or method is required for fill_nulls")
    if fill is None:
        return df
    kind = cells.dtype_of(df, column)
    if cells.is_number(kind) and isinstance(fill, float) and not fill.is_integer():
        return _replace(df, column, F.coalesce(c.cast("double"), F.lit(fill)))
    return _replace(df, column, F.coalesce(c, F.lit(fill).cast(kind)))


INT_NAMES = ("int", "integer")
FLOAT_NAMES = ("float", "number")
TEXT_NAMES = ("str", "string", "text")
DATE_NAMES = ("datetime", "date")


def fractional(df, column) -> bool:
    x = number(quoted(column))
    return df.agg(F.coalesce(F.max(x != F.floor(x)), F.lit(False))).first()[0]


def casted(c, dtype):
    """The cell as ``dtype``, or null where it does not parse."""
    if dtype in INT_NAMES:
        return F.coalesce(c.try_cast("long"), number(c).try_cast("long"))
    if dtype in FLOAT_NAMES:
        return number(c)
    if dtype in TEXT_NAMES:
        return text(c)
    if dtype in DATE_NAMES:
        return cells.timestamp(c)
    return None


def cast_type(df, column, dtype):
    need_columns(df, [column])
    c = quoted(column)
    if dtype == "bool":
        if cells.is_text(cells.dtype_of(df, column)):
            truth = F.when(c.isNull(), True).otherwise(F.length(c) > 0)
        else:
            truth = F.coalesce(c.cast("double") != 0, F.lit(True))
        return _replace(df, column, truth)
    made = casted(c, dtype)
    if made is None:
        raise Refusal(f"Unknown dtype: {dtype}")
    if dtype in INT_NAMES and fractional(df, column):
        raise Refusal(f"Failed to cast '{column}' to {dtype}: values have fractions")
    return _replace(df, column, made)


def reorder_columns(df, order):
    if not order:
        raise Refusal("Column order list is required")
    need_columns(df, order)
    return df.select(*[quoted(c) for c in [*order, *[c for c in df.columns if c not in order]]])


def preview_page(
    df, rid, page=1, page_size=50, sort_by=None, sort_desc=False,
    filter_column=None, filter_value=None, fences=None,
):
    """One page of rows with, per cell, what is wrong with it.

    ``fences`` maps a column to its recorded (lower, upper) outlier cutoffs. Row numbers
    ahead of the page are skipped by a top-k sort, so cost follows the depth of the page.
    """
    if filter_column in df.columns and filter_value:
        df = df.where(predicate(df, filter_column, "contains", filter_value))
    keys = [quoted(rid).asc()]
    if sort_by in df.columns:
        c = quoted(sort_by)
        keys.insert(0, c.desc_nulls_last() if sort_desc else c.asc_nulls_last())
    pages = max(1, -(-df.count() // page_size))
    page = max(1, min(page, pages))
    rows = df.orderBy(*keys).offset((page - 1) * page_size).limit(page_size)
    notes = []
    for c in df.columns:
        lower, upper = (fences or {}).get(c, (None, None))
        note = F.when(quoted(c).isNull(), F.lit(f"{c}:null"))
        if lower is not None and upper is not None:
            x = cells.undecorated(quoted(c))
            note = note.when((x < lower) | (x > upper), F.lit(f"{c}:outlier"))
        notes.append(note)
    return rows.withColumn("_annotations", F.array_compact(F.array(*notes)))
