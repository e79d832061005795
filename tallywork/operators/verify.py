"""Checking a cleaned table: flags before and after, step postconditions, audit coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from tallywork.functions import cells
from tallywork.functions.cells import dtype_of, is_text, number, quoted, text
from tallywork.operators.outliers import Policy, extreme_test
from tallywork.operators.quality import dirty_name, incomplete_test, quality_flags

RESULT = "step_index int, operation string, column string, passed boolean, n_bad long, examples array<string>"

# cells that may not be left after a step, and how many of them are shown
LEFT_OVER = {
    "remove_currency_symbols": lambda q: cells.has_currency(q),
    "free_to_zero": lambda q: cells.starts_free(q),
    "convert_number_words": lambda q: cells.is_number_word(q),
    "remove_vague_entries": lambda q: cells.is_vague(q),
    "strip_whitespace": lambda q: F.coalesce(text(q) != cells.strip(text(q)), F.lit(False)),
}
TYPES = {"int": (T.IntegralType,), "float": (T.DoubleType, T.FloatType), "str": (T.StringType,),
         "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType)}


def _cell_test(df: DataFrame, step: dict):
    """Test for cells that break a step's postcondition, or None if it has no cell rule."""
    name, column, params = step["operation"], step.get("column"), step.get("params") or {}
    if name == "drop_incomplete_responses":
        return incomplete_test(df)
    if column not in df.columns:
        return None
    if name in LEFT_OVER:
        if name == "strip_whitespace" and not is_text(dtype_of(df, column)):
            return None
        return LEFT_OVER[name](quoted(column))
    if name == "cap_extreme_values" and params.get("max_value") is not None:
        return F.coalesce(number(quoted(column)) > F.lit(params["max_value"]), F.lit(False))
    return None


def postconditions(
    cleaned: DataFrame, steps: list[dict], rid: str, rows_before: int | None = None,
    policy: Policy | None = None, failed: list[dict] = (),
) -> DataFrame:
    """One row per step. All cell rules share one aggregation; examples are read only for
    rules that were broken."""
    policy = policy or Policy()
    broken = {f["step_index"] for f in failed}
    tests = {i: _cell_test(cleaned, s) for i, s in enumerate(steps) if i not in broken}
    tests = {i: t for i, t in tests.items() if t is not None}
    numeric = {
        i: quoted(s["column"]) for i, s in enumerate(steps)
        if s["operation"] == "extract_number" and s.get("column") in cleaned.columns
    }
    got = cleaned.agg(
        F.count("*").alias("rows"),
        *[F.count_if(t).alias(f"t{i}") for i, t in tests.items()],
        *[F.count(q).alias(f"p{i}") for i, q in numeric.items()],
        *[F.count(number(q)).alias(f"x{i}") for i, q in numeric.items()],
        *[F.count(quoted(c)).alias(f"c{j}") for j, c in enumerate(cleaned.columns)],
    ).first()
    rows = []
    for i, step in enumerate(steps):
        name, column, params = step["operation"], step.get("column"), step.get("params") or {}
        bad, shown = 0, []
        if i in broken:
            rows.append((i, name, column, False, None, []))
            continue
        if i in tests:
            bad = got[f"t{i}"]
            if bad and column in cleaned.columns and name != "strip_whitespace":
                first = cleaned.where(tests[i]).orderBy(quoted(rid)).limit(5)
                shown = [r[0] for r in first.select(text(quoted(column))).collect()]
        passed = bad == 0
        if i in numeric and got[f"p{i}"]:
            bad = got[f"p{i}"] - got[f"x{i}"]
            passed = got[f"x{i}"] >= 0.9 * got[f"p{i}"]
        elif name == "cast_type" and column in cleaned.columns:
            passed = isinstance(dtype_of(cleaned, column), TYPES.get(params.get("target_type"), ()))
        elif name == "drop_rows" and params.get("indices") and rows_before is not None:
            passed = rows_before - got["rows"] >= len(params["indices"])
        elif name == "deduplicate":
            keys = params.get("subset") or [c for c in cleaned.columns if c != rid]
            bad = got["rows"] - cleaned.groupBy(*[quoted(k) for k in keys]).agg(F.lit(1)).count()
            passed = bad == 0
        elif name == "clean_column_names":
            bad = sum(dirty_name(c) for c in cleaned.columns)
            passed = bad == 0
        elif name == "drop_empty_columns":
            bad = sum(got[f"c{j}"] == 0 for j in range(len(cleaned.columns)))
            passed = bad == 0
        elif name == "flag_extreme_outliers" and not _flag_column(cleaned, column):
            test = None
            if column in cleaned.columns:
                test = extreme_test(cleaned, column, policy, params.get("threshold"))
            bad = cleaned.where(test(quoted(column))).count() if test is not None else 0
            passed = column in cleaned.columns and bad == 0
        rows.append((i, name, column, bool(passed), int(bad), shown))
    return cleaned.sparkSession.createDataFrame(rows, RESULT)


def _flag_column(df: DataFrame, column: str) -> bool:
    return f"{column}_flagged" in df.columns or "_flagged" in df.columns


FLAG_CELLS = {
    "currency": cells.has_currency,
    "free": cells.starts_free,
    "number_words": cells.is_number_word,
    "vague": cells.is_vague,
    "embedded_text": cells.has_embedded_text,
}


def flag_key():
    """Structural flags count under their own name, cell flags under their column."""
    structural = F.col("flag").isin("dirty_name", "empty_column", "incomplete_responses", "header_row")
    return F.when(structural, F.col("flag")).otherwise(F.col("column"))


def audit_completeness(original: DataFrame, flags: DataFrame, audit: DataFrame) -> DataFrame:
    """Share of the flagged cells that the audit mentions; 1 when nothing was flagged."""
    listed = [(r["column"], r["flag"]) for r in flags.select("column", "flag").collect()]
    per_column: dict[str, list] = {}
    for column, flag in listed:
        if flag in FLAG_CELLS and column in original.columns:
            per_column.setdefault(column, []).append(FLAG_CELLS[flag](quoted(column)))
    spark = original.sparkSession
    if per_column:
        sums = [
            F.struct(F.lit(c).alias("column"),
                     F.sum(sum((t.cast("long") for t in ts), F.lit(0))).alias("flagged"))
            for c, ts in per_column.items()
        ]
        flagged = original.agg(F.array(*sums).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    else:
        flagged = spark.createDataFrame([], "column string, flagged long")
    touched = audit.groupBy("column").agg(F.count_distinct("row").alias("touched"))
    both = flagged.join(touched, "column", "left").selectExpr(
        "flagged", "least(coalesce(touched, 0), flagged) AS addressed")
    if any(flag == "header_row" for _, flag in listed):
        dropped = audit.where("operation = 'drop_rows'").limit(1).agg(F.count("*").alias("addressed"))
        both = both.unionByName(dropped.select(F.lit(1).cast("long").alias("flagged"), "addressed"))
    return both.agg(
        F.coalesce(F.sum("flagged"), F.lit(0)).alias("n_flagged"),
        F.coalesce(F.sum("addressed"), F.lit(0)).alias("n_addressed"),
    ).withColumn("completeness", F.expr(
        "CASE WHEN n_flagged = 0 THEN 1.0D ELSE round(n_addressed / n_flagged, 4) END"))


@dataclass
class Verification:
    passed: bool
    flags: DataFrame  # key, status: resolved | remaining | new
    steps: DataFrame
    completeness: DataFrame


def flag_status(before: DataFrame, after: DataFrame) -> DataFrame:
    a = before.select(flag_key().alias("key")).distinct().withColumn("was", F.lit(True))
    b = after.select(flag_key().alias("key")).distinct().withColumn("is", F.lit(True))
    return a.join(b, "key", "full").select("key", F.expr(
        "CASE WHEN was AND is THEN 'remaining' WHEN was THEN 'resolved' ELSE 'new' END").alias("status"))


def verify_cleaning(
    original: DataFrame, cleaned: DataFrame, audit: DataFrame, steps: list[dict], rid: str,
    failed: list[dict] = (), policy: Policy | None = None,
) -> Verification:
    before, after = quality_flags(original, rid), quality_flags(cleaned, rid)
    status = flag_status(before, after)
    results = postconditions(cleaned, steps, rid, original.count(), policy, failed)
    remaining = status.where("status = 'remaining'").limit(1).count()
    all_passed = results.where("NOT passed").limit(1).count() == 0
    return Verification(
        all_passed and not remaining and not failed, status, results,
        audit_completeness(original, before, audit))
