"""Inferring a declared schema from values, and checking a table against one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tallywork.functions import cells, fixed
from tallywork.functions.cells import dtype_of, is_date, number, quoted, text
from tallywork.operators.profiling import heads, level_counts, named, present

SCHEMA = "i int, nullable boolean, min double, max double, max_length int, avg_length double, storage string"


def _storage(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    return "datetime" if is_date(dtype) else "text"


def infer_schema(df: DataFrame, rid: str) -> DataFrame:
    """One row per column: type, nullable, unique, range, allowed values, lengths, constraints."""
    columns = [c for c in df.columns if c != rid]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count(F.when(present(df, c), 1)).alias(f"n{i}"))
        if _storage(dtype_of(df, c)) in ("integer", "float"):
            aggs += [F.min(number(quoted(c))).alias(f"min{i}"), F.max(number(quoted(c))).alias(f"max{i}")]
        else:
            length = F.length(text(quoted(c)))
            aggs += [F.max(length).alias(f"len{i}"), F.avg(length).alias(f"avg{i}")]
    s = df.agg(*aggs).first().asDict()
    base = df.sparkSession.createDataFrame([
        (i, s[f"n{i}"] < s["rows"], s.get(f"min{i}"), s.get(f"max{i}"), s.get(f"len{i}"), s.get(f"avg{i}"),
         _storage(dtype_of(df, c))) for i, c in enumerate(columns)
    ], SCHEMA)
    counts = level_counts(df, columns)
    boolean = F.lower(cells.strip(F.col("value"))).isin(fixed.BOOLEAN_WORDS)
    levels = counts.groupBy("i").agg(
        F.count("*").alias("distinct"), F.sum("n").alias("n"), F.bool_and(boolean).alias("all_boolean"))
    few = counts.join(levels.where("distinct <= 20").select("i"), "i").groupBy("i").agg(
        F.sort_array(F.collect_list("value")).alias("levels"))
    v = F.col("value")
    share = lambda test: F.avg(test.cast("double"))
    head = heads(df, rid, columns, 50).groupBy("i").agg(
        share(number(v).isNotNull()).alias("numbers"), share(cells.timestamp(v).isNotNull()).alias("dates"),
        share(v.rlike(fixed.EMAIL_START)).alias("emails"))
    x = base.join(levels, "i", "left").join(few, "i", "left").join(head, "i", "left")
    x = x.withColumn("type", F.expr(
        "CASE WHEN storage <> 'text' THEN storage WHEN n IS NULL THEN 'unknown' "
        "WHEN numbers > 0.8 THEN 'numeric_string' WHEN dates > 0.7 THEN 'date_string' "
        "WHEN emails > 0.5 THEN 'email' WHEN all_boolean THEN 'boolean_string' "
        "WHEN distinct <= 20 AND n > 10 THEN 'categorical' ELSE 'string' END"))
    x = x.withColumn("unique", F.expr("coalesce(distinct = n, FALSE)"))
    return named(x.selectExpr(
        "i", "type", "nullable", "unique", "min", "max",
        "CASE WHEN type = 'categorical' THEN levels END AS allowed_values",
        "CASE WHEN type = 'string' THEN max_length END AS max_length",
        "CASE WHEN type = 'string' THEN round(avg_length, 1) END AS avg_length",
        "concat_ws(', ', CASE WHEN NOT nullable THEN 'NOT NULL' END, CASE WHEN unique THEN 'UNIQUE' END) AS constraints",
    ), columns)


VIOLATION = "type string, column string, severity string, n long"


def validate_schema(df: DataFrame, declared: list[dict]) -> DataFrame:
    """Violations of a declared schema; all cell rules are counted in one aggregation.

    ``declared``: dicts with name and optionally type, nullable, min, max, allowed_values.
    """
    names = {d["name"] for d in declared}
    rows, aggs = [], []
    for d in declared:
        name = d["name"]
        if name not in df.columns:
            rows.append(("missing_column", name, "error", None))
            continue
        c, x = quoted(name), number(quoted(name))
        kind = _storage(dtype_of(df, name))
        if not d.get("nullable", True):
            aggs.append(("null_violation", name, "error", F.count_if(~present(df, name))))
        if d.get("type") == "integer" and kind != "integer":
            aggs.append(("type_mismatch", name, "warning", F.count_if(present(df, name) & x.isNull())))
        if d.get("min") is not None and d.get("max") is not None:
            out = (x < F.lit(float(d["min"]))) | (x > F.lit(float(d["max"])))
            aggs.append(("range_violation", name, "warning", F.count_if(out)))
        if d.get("allowed_values") is not None:
            out = present(df, name) & ~text(c).isin([str(v) for v in d["allowed_values"]])
            aggs.append(("value_violation", name, "warning", F.count_if(out)))
    if aggs:
        counted = df.agg(*[a[3].alias(f"v{i}") for i, a in enumerate(aggs)]).first()
        rows += [(t, c, s, counted[i]) for i, (t, c, s, _) in enumerate(aggs) if counted[i] > 0]
    rows += [("extra_column", c, "info", None) for c in df.columns if c not in names]
    return df.sparkSession.createDataFrame(rows, VIOLATION)
