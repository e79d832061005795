"""Column profiles and the suggestions read off them.

Cells are melted to (column, value) pairs and counted; the pairs collapse on the map side,
so a value that fills a third of a column is one row per task. Everything that is one
number per column is gathered in one wide aggregation.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F, Window as W

from tallywork.functions import cells, fixed
from tallywork.functions.cells import dtype_of, is_date, is_number, is_text, number, quoted, text
from tallywork.operators.ordering import exact_quantiles


def melt(df: DataFrame, columns: list[str], rid: str | None = None) -> DataFrame:
    """Non-null cells as (i, value): the position in ``columns`` and the cell as text."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(present(df, c), text(quoted(c))).alias("value"))
        for i, c in enumerate(columns)
    ])
    kept = [quoted(rid).alias("_rid")] if rid else []
    return df.select(*kept, F.inline(pairs)).where("value IS NOT NULL")


def present(df: DataFrame, column: str):
    c = quoted(column)
    floating = dtype_of(df, column).typeName() in ("double", "float")
    return c.isNotNull() & ~F.isnan(c) if floating else c.isNotNull()


def melt_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-null numeric cells as (i, x)."""
    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), number(quoted(c)).alias("x")) for i, c in enumerate(columns)
    ])
    return df.select(F.inline(pairs)).where("x IS NOT NULL")


def first_seen(df: DataFrame, columns: list[str], rows: int = 5_000) -> dict[str, tuple[int, int]]:
    """(values, distinct values) among a few rows that Spark reads first.

    Distinct values of some rows are a lower bound, and a repeated value is a proof: enough
    to rule columns out before their exact count.
    """
    if not columns:
        return {}
    short = lambda c: F.md5(quoted(c)) if is_text(dtype_of(df, c)) else quoted(c)  # bounds long cells
    some = df.select(*[F.when(present(df, c), short(c)) for c in columns]).limit(rows).collect()
    found = {}
    for i, c in enumerate(columns):
        values = [r[i] for r in some if r[i] is not None]
        found[c] = (len(values), len(set(values)))
    return found


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """Turn the position back into the column's name."""
    names = F.array(*[F.lit(c) for c in columns])
    return df.select(F.get(names, F.col("i")).alias("column"), *[c for c in df.columns if c != "i"])


def level_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, value, n) for every distinct non-null value of the columns."""
    return melt(df, columns).groupBy("i", "value").agg(F.count("*").alias("n"))


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent values per column, as an array of (value, n)."""
    first = W.partitionBy("i").orderBy(F.col("n").desc(), F.col("value"))
    top = counts.withColumn("_r", F.row_number().over(first)).where(f"_r <= {k}")
    return top.groupBy("i").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_r"), "value", "n"))).alias("_top")
    ).select("i", F.expr("transform(_top, s -> named_struct('value', s.value, 'n', s.n))").alias("top_values"))


PROFILE = (
    "i int, dtype string, row_count long, null_count long, null_pct double, mean double, std double, "
    "min double, max double, median double, q25 double, q75 double, p95 double, p99 double, "
    "mad double, avg_length double, max_length int, min_date string, max_date string"
)


def _round(x, digits):
    return None if x is None else round(float(x), digits)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, distinct values and the statistics of its kind."""
    columns = df.columns
    numeric = [c for c in columns if is_number(dtype_of(df, c))]
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        kind, q = dtype_of(df, c), quoted(c)
        aggs.append(F.count(F.when(present(df, c), 1)).alias(f"n{i}"))
        if is_number(kind):
            x = number(q)
            aggs += [F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                     F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        elif is_text(kind):
            aggs += [F.avg(F.length(q)).alias(f"avg{i}"), F.max(F.length(q)).alias(f"len{i}")]
        elif is_date(kind):
            aggs += [F.min(q).cast("string").alias(f"from{i}"), F.max(q).cast("string").alias(f"to{i}")]
    s = df.agg(*aggs).first().asDict()
    xs = {c: number(quoted(c)) for c in numeric}
    q = exact_quantiles(df, xs, [0.25, 0.5, 0.75, 0.95, 0.99])
    away = {c: F.abs(xs[c] - F.lit(q[c][1])) for c in numeric if q[c][1] is not None}
    mad = exact_quantiles(df, away, [0.5]) if away else {}
    rows = []
    for i, c in enumerate(columns):
        total, n = s["rows"], s[f"n{i}"]
        quarts = q.get(c, [None] * 5)
        rows.append((
            i, df.schema[c].dataType.simpleString(), total, total - n,
            round((total - n) / total * 100, 2) if total else 0.0,
            _round(s.get(f"mean{i}"), 4), _round(s.get(f"std{i}"), 4),
            s.get(f"min{i}"), s.get(f"max{i}"), _round(quarts[1], 4), quarts[0], quarts[2],
            _round(quarts[3], 4), _round(quarts[4], 4), _round(mad.get(c, [None])[0], 4),
            _round(s.get(f"avg{i}"), 2), s.get(f"len{i}"), s.get(f"from{i}"), s.get(f"to{i}"),
        ))
    counts = level_counts(df, columns)
    distinct = counts.groupBy("i").agg(F.count("*").alias("unique_count"))
    texts = [i for i, c in enumerate(columns) if is_text(dtype_of(df, c))]
    top = top_values(counts.where(F.col("i").isin(texts)))
    out = df.sparkSession.createDataFrame(rows, PROFILE)
    out = out.join(distinct, "i", "left").join(top, "i", "left")
    return named(out.fillna(0, ["unique_count"]), columns)


def heads(df: DataFrame, rid: str, columns: list[str], k: int) -> DataFrame:
    """The first k non-null cells of each column in row order, as text."""
    first = W.partitionBy("i").orderBy("_rid")
    return melt(df, columns, rid).withColumn("_r", F.row_number().over(first)).where(f"_r <= {k}")


# ------------------------------------------------------------------------- suggestions


def suggest_drop(df: DataFrame, rid: str | None = None) -> DataFrame:
    """All-null (1.0), constant (0.9) and id-named (0.7) columns."""
    columns = [c for c in df.columns if c != rid]
    stats = level_counts(df, columns).groupBy("i").agg(
        F.count("*").alias("k"), F.sum("n").alias("n"))
    frame = df.sparkSession.createDataFrame(
        [(i, bool(re.match(fixed.ID_NAME, c, re.I))) for i, c in enumerate(columns)], "i int, id_named boolean")
    out = frame.join(stats, "i", "left").select(
        "i",
        F.expr("CASE WHEN k IS NULL THEN 'all null' WHEN k = 1 AND n > 1 THEN 'constant' "
               "WHEN id_named THEN 'id name' END").alias("reason"),
        F.expr("CASE WHEN k IS NULL THEN 1.0D WHEN k = 1 AND n > 1 THEN 0.9D WHEN id_named THEN 0.7D END")
        .alias("confidence"))
    return named(out.where("reason IS NOT NULL"), columns)


def suggest_type(df: DataFrame, rid: str) -> DataFrame:
    """Text columns whose first 50 values mostly (>80 %) read as dates, else as numbers."""
    columns = [f.name for f in df.schema if is_text(f.dataType) and f.name != rid]
    v = F.col("value")
    shares = heads(df, rid, columns, 50).groupBy("i").agg(
        F.avg(cells.timestamp(v).isNotNull().cast("double")).alias("dates"),
        F.avg(number(v).isNotNull().cast("double")).alias("numbers"))
    out = shares.select("i", F.expr(
        "CASE WHEN dates > 0.8 THEN 'datetime' WHEN numbers > 0.8 THEN 'numeric' END").alias("suggested_type"),
        F.expr("round(CASE WHEN dates > 0.8 THEN dates ELSE numbers END, 2)").alias("confidence"))
    return named(out.where("suggested_type IS NOT NULL"), columns)


def suggest_variants(df: DataFrame, rid: str | None = None) -> DataFrame:
    """Frequent values that are equal after trimming and lower-casing (2 to 50 distinct)."""
    columns = [f.name for f in df.schema if is_text(f.dataType) and f.name != rid]
    counts = level_counts(df, columns)
    few = counts.groupBy("i").agg(F.count("*").alias("k")).where("k BETWEEN 2 AND 50").select("i")
    top = top_values(counts).join(few, "i").select("i", F.explode("top_values").alias("s"))
    groups = top.groupBy("i", F.lower(cells.strip(F.col("s.value"))).alias("key")).agg(
        F.sort_array(F.collect_set("s.value")).alias("variants"))
    return named(groups.where("size(variants) > 1"), columns)


def detect_pii(df: DataFrame, rid: str) -> DataFrame:
    """First pattern that matches the start of more than half of the first 20 values."""
    columns = [f.name for f in df.schema if is_text(f.dataType) and f.name != rid]
    shares = heads(df, rid, columns, 20).groupBy("i").agg(*[
        F.avg(F.col("value").rlike("^(?:" + pattern + ")").cast("double")).alias(name)
        for name, pattern in fixed.PII
    ])
    kind, share = F.lit(None).cast("string"), F.lit(None).cast("double")
    for name, _ in reversed(fixed.PII):
        kind = F.when(F.col(name) > 0.5, F.lit(name)).otherwise(kind)
        share = F.when(F.col(name) > 0.5, F.col(name)).otherwise(share)
    out = shares.select("i", kind.alias("pii_type"), F.round(share * 100, 1).alias("match_pct"))
    return named(out.where("pii_type IS NOT NULL"), columns)


def smart_suggestions(df: DataFrame, rid: str) -> DataFrame:
    """All suggestions as (column, kind, detail, confidence). A column that should change
    type is not also checked for variants and personal data."""
    retyped = suggest_type(df, rid)
    rest = retyped.select("column")
    parts = [
        suggest_drop(df, rid).selectExpr("column", "'drop' AS kind", "reason AS detail", "confidence"),
        retyped.selectExpr("column", "'type' AS kind", "suggested_type AS detail", "confidence"),
        suggest_variants(df, rid).join(rest, "column", "left_anti").selectExpr(
            "column", "'variants' AS kind", "array_join(variants, ' / ') AS detail", "CAST(NULL AS DOUBLE) AS confidence"),
        detect_pii(df, rid).join(rest, "column", "left_anti").selectExpr(
            "column", "'pii' AS kind", "pii_type AS detail", "match_pct / 100 AS confidence"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def data_dictionary(df: DataFrame) -> DataFrame:
    """Name, type, share missing, distinct count, top five values and range per column."""
    return column_profile(df).selectExpr(
        "column", "dtype", "null_pct", "unique_count",
        "array_join(transform(slice(top_values, 1, 5), s -> s.value), ', ') AS top5", "mean", "min", "max")


def discover_categories(df: DataFrame, max_levels: int = 50) -> DataFrame:
    """Distinct values of all text columns that have at most ``max_levels`` of them.

    Columns that show more values within some rows are ruled out first; the exact count
    of the others decides.
    """
    columns = [f.name for f in df.schema if is_text(f.dataType)]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, levels array<string>")
    likely = [c for c, (_, k) in first_seen(df, columns).items() if k <= max_levels]
    counts = level_counts(df, likely) if likely else level_counts(df.limit(0), columns[:1])
    few = counts.groupBy("i").agg(F.count("*").alias("k")).where(f"k <= {max_levels}")
    levels = counts.join(F.broadcast(few), "i").groupBy("i").agg(  # one row per column
        F.sort_array(F.collect_list("value")).alias("levels"))
    return named(levels, likely or columns[:1])
