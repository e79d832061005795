"""Quality rules whose thresholds follow the data: quantile sketches per language and source.

Each text gives five measures. Mergeable sketches (KLL) of four ratios are built per language and source in
one aggregation and merged to sketches per language and over all. A threshold is a quartile plus or minus
``reach`` times the distance between the quartiles (never less than a stated spread, so that a ratio that is
nearly always 0 does not condemn a single symbol). Groups of fewer than ``least`` rows use their language's
sketch, small languages the one over all. The thresholds are joined to the rows by language and source.

Only DataFrame functions are used; nothing but the measures of a row is ever moved. Defined results: null
and empty texts have no words and fail the base rule; null languages and sources are groups of their own;
repeated rows count each time; rows that fail the base rule do not enter the sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import take
from tallywork.session import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
# Ratio -> the least spread between the quartiles that is taken as real.
SPREAD = {"word_length": 1.0, "symbols": 0.05, "dup_lines": 0.02, "repeats": 0.10}


def measures(df: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five measures of ``text``. No array is worked out twice."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = df.select(
        "doc_id", "lang", "source", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        words.alias("w"), lines.alias("lines"))
    own = own.select(
        "doc_id", "lang", "source", "n_symbols", "w", F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    starts = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    own = own.withColumn("h", F.transform(starts, lambda i: F.xxhash64(
        F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).drop("w")
    repeats = F.size("h") > F.size(F.array_distinct("h"))
    # windows by hash, with their place; equal neighbours are repeated windows
    own = own.withColumn("s", F.when(repeats, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    own = own.drop("h")
    same = lambda x, j: F.coalesce(F.get("s", j)["h"] == x["h"], F.lit(False))
    found = F.transform("s", lambda x, j: F.when(same(x, j + 1) | ((j > 0) & same(x, j - 1)), x["i"]))
    covered = F.flatten(F.transform(F.filter(found, lambda p: p.isNotNull()), lambda p: F.array(p, p + 1, p + 2)))
    return own.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "word_length": F.col("word_chars") / n, "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / n, "repeats": F.col("n_repeat_words") / n,
    }


def thresholds(rows: DataFrame, least: int = 100, reach: float = 3.0, k: int = 2000) -> DataFrame:
    """One row per language and source of ``rows`` (lang, source, ratios) with low and high bounds."""
    size = F.lit(k)
    groups = rows.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, size).alias(c) for c in SPREAD])
    groups = cut_lineage(groups)
    merge = [F.kll_merge_agg_double(c, size).alias(c) for c in SPREAD]
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n"), *merge)
    whole = groups.agg(*merge)
    own = F.struct(*SPREAD)
    by_lang = langs.select(F.col("lang").alias("_lang"), F.when(F.col("n") >= least, own).alias("_by_lang"))
    over_all = whole.select(own.alias("_over_all"))
    told = groups.select("lang", "source", F.when(F.col("n") >= least, own).alias("_own"))
    told = told.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).crossJoin(F.broadcast(over_all))  # one row
    told = told.select("lang", "source", F.coalesce("_own", "_by_lang", "_over_all").alias("t"))
    out = ["lang", "source"]
    for c, spread in SPREAD.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col("t")[c], F.lit(q)) for q in (0.25, 0.75))
        reached = reach * F.greatest(q3 - q1, F.lit(spread))
        out += [(q1 - reached).alias(f"{c}_low"), (q3 + reached).alias(f"{c}_high")]
    return told.select(*out)


def judge(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    least: int = 100, reach: float = 3.0,
) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every row of ``df``."""
    rows = cut_lineage(measures(take(df, doc_id=doc_id, text=text, lang=lang, source=source)))
    rows = rows.withColumn("base_failed", base_failed()).withColumns(ratios())
    bounds = thresholds(rows.where("not base_failed"), least, reach)
    bounds = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    fine = F.col("word_length").between(F.col("word_length_low"), F.col("word_length_high"))
    for c in ("symbols", "dup_lines", "repeats"):
        fine &= F.col(c) <= F.col(f"{c}_high")
    kept = ~F.col("base_failed") & F.coalesce(fine, F.lit(False))
    return rows.join(bounds, on, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
