"""Quality problems per column: how many cells, and the first few of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, Window as W

from tallywork.errors import need_columns
from tallywork.functions import cells, fixed
from tallywork.functions.cells import dtype_of, is_number, is_text, number, quoted, text, undecorated
from tallywork.operators.ordering import exact_quantiles
from tallywork.operators.outliers import detection_fences

FLAGS = "column string, flag string, n long, lower_fence double, upper_fence double"


def dirty_name(name: str) -> bool:
    return name != name.strip() or "\u00a0" in name or "  " in name


def skipped_name(name: str) -> bool:
    return bool(re.search(fixed.SKIP_NUMERIC_NAME, name, re.I))


def numeric_name(name: str) -> bool:
    return not skipped_name(name) and bool(re.search(fixed.NUMERIC_NAME, name, re.I))


def is_header_row(df: DataFrame, rid: str, columns: list[str]) -> bool:
    """Is the first row mostly long question texts?"""
    texts = [c for c in columns if is_text(dtype_of(df, c))]
    if not texts:
        return False
    long = sum((F.coalesce((F.length(quoted(c)) > 40).cast("int"), F.lit(0)) for c in texts), F.lit(0))
    row = df.select(F.min_by(long, quoted(rid))).first()
    return row[0] is not None and row[0] >= max(3, len(columns) * 0.25)


def detect_domain(df: DataFrame, rid: str) -> str | None:
    columns = [c for c in df.columns if c != rid]
    if len({c.strip().lower() for c in columns} & fixed.SURVEY_MARKERS) >= 2:
        return "survey"
    return "survey" if is_header_row(df, rid, columns) else None


def incomplete_test(df: DataFrame):
    """Survey response not finished: progress below 100 and not marked as finished."""
    if "Progress" not in df.columns:
        return None
    low = number(quoted("Progress")) < 100
    for name in ("Finished", "finished", "FINISHED"):
        if name in df.columns:
            low = low & ~cells.is_finished(quoted(name))
            break
    return F.coalesce(low, F.lit(False))


def _rules(df: DataFrame, columns: list[str], survey: bool) -> list[tuple]:
    """(column, flag, test, examples wanted) for every cell rule that applies."""
    rules = []
    for c in columns:
        kind, q = dtype_of(df, c), quoted(c)
        named_numeric = survey and numeric_name(c)
        if not skipped_name(c) and named_numeric and not is_number(kind):
            rules += [
                (c, "currency", cells.has_currency(q, fixed.CURRENCY_DETECT), 4),
                (c, "free", cells.starts_free(q), 3),
                (c, "embedded_text", cells.has_embedded_text(q), 6),
            ]
        if is_text(kind):
            rules.append((c, "number_words", cells.is_number_word(q), 3))
            if named_numeric:
                rules.append((c, "vague", cells.is_vague_word(q), 3))
    return rules


def quality_flags(df: DataFrame, rid: str, domain: str | None = "auto") -> DataFrame:
    """All flags as rows (column, flag, n, lower_fence, upper_fence, examples).

    One wide aggregation counts every rule. Examples are the first flagged cells in row
    order; the row-number limit keeps only that many per task before anything is shuffled.
    """
    need_columns(df, [rid])
    columns = [c for c in df.columns if c != rid]
    survey = (detect_domain(df, rid) if domain == "auto" else domain) == "survey"
    rules = _rules(df, columns, survey)
    outlier_columns = {
        c: number(quoted(c)) if is_number(dtype_of(df, c)) else undecorated(quoted(c)) for c in columns
        if not skipped_name(c) and (is_number(dtype_of(df, c)) or (survey and numeric_name(c)))
    }
    fences = {c: f for c, f in detection_fences(df, outlier_columns).items() if f}
    for c, (lo, hi) in fences.items():
        x = outlier_columns[c]
        test = F.coalesce((x < F.lit(lo)) | (x > F.lit(hi)), F.lit(False))
        rules.append((c, "extreme_outliers", test, 3))
    incomplete = incomplete_test(df) if survey else None
    if incomplete is not None:
        rules.append(("Progress", "incomplete_responses", incomplete, 20))

    # a count of 0 beside 'empty' means that every cell of the column is missing
    counts = df.agg(
        *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.count_if(test).alias(f"r{i}") for i, (_, _, test, _) in enumerate(rules)],
    ).first()
    found = [(i, *rule) for i, rule in enumerate(rules) if counts[f"r{i}"] > 0]
    found = _short_currency(df, found)
    rows = [(c, "dirty_name", None, None, None) for c in columns if dirty_name(c)]
    rows += [(c, "empty_column", None, None, None) for i, c in enumerate(columns) if counts[f"n{i}"] == 0]
    if survey and is_header_row(df, rid, columns):
        rows.append((None, "header_row", 1, None, None))
    spark = df.sparkSession
    structural = spark.createDataFrame(rows, FLAGS).withColumn("examples", F.array().cast("array<string>"))
    if not found:
        return structural
    cell_rows = spark.createDataFrame(
        [(c, flag, counts[f"r{i}"], *(fences.get(c, (None, None)) if flag == "extreme_outliers" else (None, None)))
         for i, c, flag, _, _ in found], FLAGS)
    examples = _examples(df, rid, found)
    joined = cell_rows.join(F.broadcast(examples), ["column", "flag"], "left")  # one row per flag
    shown = joined.where("flag <> 'embedded_text' OR size(examples) > 0")
    return structural.unionByName(shown)


def _short_currency(df, found):
    """Currency signs count only in columns of short cells (median length below 30)."""
    money = {c for _, c, flag, _, _ in found if flag == "currency"}
    if not money:
        return found
    lengths = exact_quantiles(df, {c: F.length(text(quoted(c))) for c in money}, [0.5])
    return [f for f in found if f[2] != "currency" or lengths[f[1]][0] < 30]


def _examples(df, rid, found) -> DataFrame:
    cells_hit = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(flag).alias("flag"), F.lit(k).alias("k"),
            F.when(test, (quoted(rid) if flag == "incomplete_responses" else quoted(c)).cast("string")).alias("value"))
        for _, c, flag, test, k in found
    ])
    hits = df.select(quoted(rid).alias("_rid"), F.inline(cells_hit)).where("value IS NOT NULL")
    order = W.partitionBy("column", "flag").orderBy("_rid")
    first = hits.withColumn("_r", F.row_number().over(order)).where("_r <= 20").where("_r <= k")
    first = first.where("flag <> 'embedded_text' OR length(value) < 35")
    listed = first.groupBy("column", "flag").agg(
        F.sort_array(F.collect_list(F.struct("_r", "value"))).alias("e"))
    return listed.select(
        "column", "flag", F.expr("slice(transform(e, s -> s.value), 1, CASE WHEN flag = 'embedded_text' THEN 4 ELSE 20 END)")
        .alias("examples"))


def one_flag(df: DataFrame, rid: str, flag: str, domain="auto") -> DataFrame:
    return quality_flags(df, rid, domain).where(F.col("flag") == flag)
