"""Structural facts about a table: weights, keys, dates, scales, shapes, gaps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from tallywork.functions import fixed
from tallywork.functions.cells import dtype_of, is_date, is_number, is_text, number, quoted, seconds
from tallywork.operators.means import CORRECTED_KURTOSIS, CORRECTED_SKEW
from tallywork.operators.ordering import grouped_quantiles
from tallywork.operators.profiling import (
    first_seen, level_counts, melt_numbers, named, present,
)


def tokens(name: str) -> set[str]:
    return {part for part in re.split(r"[^a-z0-9]+", name.lower()) if part}


def is_weight_name(name: str) -> bool:
    low = name.lower()
    return bool(tokens(name) & fixed.WEIGHT_TOKENS) or "weight" in low or "wgt" in low


def is_identifier_name(name: str) -> bool:
    low = name.lower()
    return bool(tokens(name) & fixed.IDENTIFIER_TOKENS) or low.endswith("id") or "uuid" in low


def _numeric(df: DataFrame) -> list[str]:
    return [
        f.name for f in df.schema
        if is_number(f.dataType) and f.dataType.typeName() != "boolean"
    ]


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per numeric column with its moments, in one pass."""
    x = F.col("x")
    return melt_numbers(df, columns).groupBy("i").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"),
        F.sum(x).alias("total"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"),
        F.avg((x == 0).cast("double")).alias("zero_share"),
        F.bool_and(x % 1 == 0).alias("integer_valued"))


def few_levels(df: DataFrame, columns: list[str], most: int) -> list[str]:
    """Columns that may have at most ``most`` distinct values."""
    return [c for c, (_, k) in first_seen(df, columns).items() if k <= most]


def _none(df: DataFrame, schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], schema)


def weight_candidates(df: DataFrame) -> DataFrame:
    """Weight-named positive columns, graded by mean, fractions and spread."""
    columns = [c for c in _numeric(df) if is_weight_name(c)]
    if not columns:
        return _none(df, "column string, confidence string, n long, mean double")
    physical = F.array(*[F.lit(bool(tokens(c) & fixed.PHYSICAL_WEIGHT_TOKENS)) for c in columns])
    x = numbers(df, columns).where("n > 0 AND minimum > 0").withColumn("physical", F.get(physical, F.col("i")))
    x = x.selectExpr(
        "*", "mean BETWEEN 0.5 AND 2.0 AS normalized", "mean >= 10 AS population",
        "maximum / minimum <= 1000 AS bounded")
    x = x.withColumn("grade", F.expr(
        "CASE WHEN minimum = maximum THEN 0 WHEN normalized AND NOT integer_valued AND bounded THEN 2 "
        "WHEN (normalized AND bounded) OR (population AND NOT integer_valued AND bounded) THEN 1 ELSE 0 END"))
    x = x.withColumn("grade", F.expr("grade - CASE WHEN physical AND grade > 0 AND minimum < maximum THEN 1 ELSE 0 END"))
    out = x.selectExpr("i", "element_at(array('low', 'moderate', 'high'), grade + 1) AS confidence", "n",
                       "mean", "minimum", "maximum", "total", "integer_valued")
    return named(out, columns)


def level_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rows, distinct values, largest and smallest level."""
    return level_counts(df, columns).groupBy("i").agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"),
        F.max("n").alias("largest"), F.min("n").alias("smallest"),
        F.min_by("value", F.struct("n", "value")).alias("smallest_level"))


def key_columns(df: DataFrame) -> DataFrame:
    """Identifier-named columns and row-unique whole numbers, with how often values repeat."""
    columns = [c for c in df.columns if is_identifier_name(c) or c in _numeric(df)]
    if not columns:
        return _none(df, "column string, distinct long")
    whole = [c for c in columns if not is_identifier_name(c)]
    integral = df.agg(F.count("*").alias("rows"), *[
        F.bool_and(number(quoted(c)) % 1 == 0).alias(f"w{i}") for i, c in enumerate(whole)]).first()
    fits = [c for c in columns if c not in whole or integral[f"w{whole.index(c)}"]]
    rows = F.lit(integral["rows"])
    # without an identifier's name a column must be row-unique: one repeated value rules it out
    seen = first_seen(df, fits)
    fits = [c for c in fits if is_identifier_name(c) or seen[c][0] == seen[c][1]]
    if not fits:
        return _none(df, "column string, distinct long")
    by_name = F.array(*[F.lit(is_identifier_name(c)) for c in fits])
    out = level_stats(df, fits).withColumn("_named", F.get(by_name, F.col("i")))
    out = out.where(F.col("_named") | (F.col("distinct") == F.col("n"))).select(
        "i", rows.alias("rows"), "distinct",
        ((F.col("largest") == 1) & (F.col("distinct") == rows)).alias("row_unique"),
        F.col("largest").alias("max_rows_per_value"),
        ((F.col("largest") == F.col("smallest")) & (F.col("largest") > 1)).alias("uniform_repeat"))
    return named(out, fits)


def date_regularity(df: DataFrame) -> DataFrame:
    """Span, distinct points, median gap in days, and whether the spacing is regular.

    Gaps run between distinct days-and-times in order, range by range.
    """
    from tallywork.operators.ordering import previous_row

    columns = [f.name for f in df.schema if is_date(f.dataType)]
    parts = []
    for i, c in enumerate(columns):
        at = quoted(c).cast("timestamp_ntz")
        points = df.where(quoted(c).isNotNull()).select(at.alias("at"), seconds(at).alias("t")).distinct()
        gaps = previous_row(points, "t", {"t": "p"}).select(
            F.lit(i).alias("i"), "at", ((F.col("t") - F.col("p")) / 86400).alias("gap"))
        stats = gaps.groupBy("i").agg(
            F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("distinct"),
            F.count("gap").alias("n_gaps"), F.avg("gap").alias("m"), F.stddev_pop("gap").alias("s"))
        medians = grouped_quantiles(gaps, "gap", {"median_gap_days": 0.5}, ["i"])
        parts.append(stats.join(medians, "i", "left"))
    if not parts:
        return _none(df, "column string, distinct long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return named(out.select(
        "i", day("a").alias("start"), day("z").alias("end"), "distinct", "median_gap_days",
        F.expr("n_gaps >= 3 AND m > 0 AND s / m <= 0.05").alias("regular"),
        (F.col("distinct") < 8).alias("too_sparse_for_trend")), columns)


def ordinal_columns(df: DataFrame) -> DataFrame:
    """Likert and 0-10 integer scales, and text columns of ordered response labels."""
    numeric, texts = _numeric(df), [f.name for f in df.schema if is_text(f.dataType)]
    likely = set(few_levels(df, numeric + texts, 11))
    numeric, texts = [c for c in numeric if c in likely], [c for c in texts if c in likely]
    columns = numeric + texts
    if not columns:
        return _none(df, "column string, levels long")
    counts = level_counts(df, columns)
    label = F.lower(F.btrim("value"))
    stats = counts.groupBy("i").agg(
        F.count("*").alias("levels"), F.count_if(label.isin(fixed.ORDINAL_LABELS)).alias("matched"))
    out = stats.where(F.col("i") >= len(numeric)).where(
        "levels BETWEEN 2 AND 9 AND matched >= 2 AND matched / levels >= 0.5").selectExpr(
        "i", "'labelled' AS kind", "levels", "CAST(NULL AS BIGINT) AS minimum", "CAST(NULL AS BIGINT) AS maximum")
    if numeric:
        tops = ", ".join(str(t) for t in fixed.LIKERT_TOPS)
        scale = numbers(df, numeric).where("integer_valued").join(stats, "i").where(
            f"(minimum = 1 AND maximum IN ({tops}) AND levels >= 3) OR "
            "(minimum = 0 AND maximum = 10 AND levels >= 8)")
        out = out.unionByName(scale.selectExpr(
            "i", "'integer_scale' AS kind", "levels", "CAST(minimum AS BIGINT) AS minimum",
            "CAST(maximum AS BIGINT) AS maximum"))
    return named(out, columns)


def numeric_shape(df: DataFrame) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis, zero share, and the kind of number."""
    columns = _numeric(df)
    if not columns:
        return _none(df, "column string, n long")
    # only a column with two values is told apart by its distinct count
    small = few_levels(df, columns, 2)
    at = F.array(*[F.lit(columns.index(c)) for c in small])
    levels = level_counts(df, small or columns[:1]).groupBy("i").agg(F.count("*").alias("distinct"))
    levels = levels.select(F.get(at, F.col("i")).alias("i"), "distinct") if small else levels.limit(0)
    x = numbers(df, columns).where("n >= 8").join(F.broadcast(levels), "i", "left")  # one row per column
    x = x.selectExpr(
        "*", f"CASE WHEN minimum < maximum THEN {CORRECTED_SKEW} END AS skewness",
        f"CASE WHEN minimum < maximum THEN {CORRECTED_KURTOSIS} END AS excess_kurtosis")
    return named(x.selectExpr(
        "i", "n", "skewness", "excess_kurtosis",
        "CASE WHEN skewness IS NULL THEN 'unknown' WHEN abs(skewness) < 0.5 THEN 'symmetric' "
        "WHEN abs(skewness) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END AS shape",
        "zero_share",
        "CASE WHEN distinct = 2 THEN 'binary' WHEN integer_valued AND minimum >= 0 THEN 'count' "
        "ELSE 'continuous' END AS kind"), columns)


def group_levels(df: DataFrame) -> DataFrame:
    """Columns with 2 to 12 repeating levels, with their smallest and largest level."""
    columns = few_levels(df, [c for c in df.columns if not is_date(dtype_of(df, c))], 12)
    if not columns:
        return _none(df, "column string, levels long")
    out = level_stats(df, columns).where("distinct BETWEEN 2 AND 12 AND n >= 2 * distinct")
    return named(out.selectExpr(
        "i", "distinct AS levels", "smallest AS min_group_size", "largest AS max_group_size",
        "smallest_level"), columns)


def missingness(df: DataFrame) -> DataFrame:
    """Null rate per column; how many rows are incomplete, and how badly."""
    columns = df.columns
    there = [present(df, c) for c in columns]
    per_row = sum(((~t).cast("int") for t in there), F.lit(0))
    rate = lambda i: 1 - F.count(F.when(F.col(f"p{i}"), 1)) / F.count("*")
    wide = df.select(*[t.alias(f"p{i}") for i, t in enumerate(there)], per_row.alias("k")).agg(
        F.array(*[F.struct(F.lit(i).alias("i"), rate(i).alias("null_rate"))
                  for i in range(len(columns))]).alias("r"),
        F.avg((F.col("k") > 0).cast("double")).alias("incomplete_row_share"),
        F.avg(F.when(F.col("k") > 0, F.col("k"))).alias("mean_missing_fields"))
    out = wide.select(F.explode("r").alias("r"), "incomplete_row_share", "mean_missing_fields")
    return named(out.select("r.*", "incomplete_row_share", "mean_missing_fields"), columns)


def low_information(df: DataFrame) -> DataFrame:
    """Near-constant columns, and text that is almost all distinct."""
    columns = [c for c in df.columns if not is_date(dtype_of(df, c))]
    is_label = F.array(*[F.lit(is_text(dtype_of(df, c))) for c in columns])
    out = level_stats(df, columns).withColumn("_text", F.get(is_label, F.col("i")))
    out = out.withColumn("reason", F.expr(
        "CASE WHEN n >= 10 AND largest / n >= 0.98 THEN 'near-constant' "
        "WHEN _text AND distinct >= 50 AND distinct / n >= 0.9 THEN 'high-cardinality' END"))
    return named(out.where("reason IS NOT NULL").selectExpr(
        "i", "reason", "n", "distinct", "largest / n AS dominant_share"), columns)
