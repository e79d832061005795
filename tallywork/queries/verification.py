"""Verification of cleaned tables and comparison of versions."""

from pyspark.sql import functions as F

from tallywork.operators import compare as c
from tallywork.operators import verify as v
from tallywork.operators.cleaning import clean
from tallywork.operators.quality import quality_flags
from tallywork.plans.cleaning_plan import run_cleaning
from tallywork.queries.base import messy, query, rounded, table, with_messy
from tallywork.queries.cleaning import PLAN
from tallywork.session import cut_lineage


def cleaned(spark, d):
    return run_cleaning(messy(spark, d), PLAN, "rid")


@query("verify_cleaning",
       "SELECT * FROM (VALUES ('amount', 'resolved'), ('incomplete_responses', 'resolved'), ('price', 'resolved')) t(key, status) "
       "WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    out = cleaned(spark, d)
    # verification reads the cleaned table many times, so it is written once
    return v.verify_cleaning(
        messy(spark, d), cut_lineage(out.df), cut_lineage(out.audit), PLAN, "rid", out.failed).flags


@query("verify_steps",
       "SELECT CAST(step_index AS INTEGER) AS step_index, operation, operation <> 'no_such_step' AS passed, n_bad FROM (VALUES " +
       ", ".join(f"({i}, '{s['operation']}', {'NULL' if s['operation'] == 'no_such_step' else 'CAST(0 AS BIGINT)'})" for i, s in enumerate(PLAN)) +
       ") t(step_index, operation, n_bad) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    out = cleaned(spark, d)
    results = v.postconditions(out.df, PLAN, "rid", failed=out.failed)
    return results.select("step_index", "operation", "passed", "n_bad")


# every postcondition is also asked of the uncleaned table, where it must count what is wrong
BROKEN = {
    "post_currency": ({"operation": "remove_currency_symbols", "column": "amount"}, "regexp_matches(amount, '[$€£¥₹]')", "amount", True),
    "post_free": ({"operation": "free_to_zero", "column": "amount"}, "starts_with(lower(trim(amount)), 'free')", "amount", True),
    "post_number_words": ({"operation": "convert_number_words", "column": "amount"}, "lower(trim(amount)) = 'five'", "amount", True),
    "post_vague": ({"operation": "remove_vague_entries", "column": "amount"}, "trim(amount) = 'n/a'", "amount", True),
    "post_extract_number": ({"operation": "extract_number", "column": "amount"},
                            "amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL", "amount", False),
    "post_strip": ({"operation": "strip_whitespace", "column": "status"}, "status <> trim(status)", "status", False),
    "post_incomplete": ({"operation": "drop_incomplete_responses"},
                        "Progress < 100 AND lower(Finished) NOT IN ('true', '1', 'yes')", None, False),
    "post_cap": ({"operation": "cap_extreme_values", "column": "price", "params": {"max_value": 500000}}, "price > 500000", "price", False),
}
for _name, (_step, _cond, _col, _shown) in BROKEN.items():
    _examples = (f"(SELECT string_agg({_col}, '|' ORDER BY rid) FROM (SELECT rid, {_col} FROM messy WHERE {_cond} ORDER BY rid LIMIT 5))"
                 if _shown else "CAST(NULL AS STRING)")
    query(_name, with_messy(
        f"SELECT '{_step['operation']}' AS operation, FALSE AS passed, count(*) AS n_bad, {_examples} AS shown FROM messy WHERE {_cond}"))(
        lambda spark, d, step=_step, with_examples=_shown: v.postconditions(messy(spark, d), [step], "rid").select(
            "operation", "passed", "n_bad",
            (F.array_join("examples", "|") if with_examples else F.lit(None).cast("string")).alias("shown")))


@query("post_dedup",
       "SELECT 'deduplicate' AS operation, FALSE AS passed, count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)) AS n_bad FROM orders")
def _(spark, d):
    steps = [{"operation": "deduplicate", "params": {"subset": ["o_custkey", "o_orderpriority"]}}]
    return v.postconditions(table(spark, d, "orders"), steps, "o_orderkey").select("operation", "passed", "n_bad")


@query("post_cast", "SELECT * FROM (VALUES (0, TRUE), (1, FALSE), (2, TRUE)) t(step_index, passed) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    steps = [{"operation": "cast_type", "column": c, "params": {"target_type": t}}
             for c, t in (("price", "float"), ("amount", "int"), ("rid", "int"))]
    return v.postconditions(messy(spark, d), steps, "rid").select("step_index", "passed")


@query("post_drop_rows", with_messy("SELECT count(*) >= 2 AS passed FROM messy"))
def _(spark, d):
    step = {"operation": "drop_rows", "params": {"indices": [1, 5]}}
    after = clean(messy(spark, d), "drop_rows", rid="rid", indices=[1, 5])
    return v.postconditions(after, [step], "rid", messy(spark, d).count()).select("passed")


@query("post_flag_outliers",
       with_messy("SELECT 0 AS step_index, FALSE AS passed, count(*) AS n_bad FROM messy, (SELECT quantile_cont(price, 0.5) AS med FROM messy) m, "
                  "(SELECT quantile_cont(abs(price - (SELECT quantile_cont(price, 0.5) FROM messy)), 0.5) AS mad FROM messy) a "
                  "WHERE 0.6745 * abs(price - med) / mad > 5"))
def _(spark, d):
    steps = [{"operation": "flag_extreme_outliers", "column": "price"}]
    return v.postconditions(messy(spark, d), steps, "rid").select("step_index", "passed", "n_bad")


@query("post_names", "SELECT * FROM (VALUES (0, FALSE, CAST(1 AS BIGINT))) t(step_index, passed, n_bad) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    df = messy(spark, d).withColumnRenamed("status", "status ")
    return v.postconditions(df, [{"operation": "clean_column_names"}], "rid").select("step_index", "passed", "n_bad")


@query("post_empty", with_messy("SELECT 0 AS step_index, FALSE AS passed, CAST(1 AS BIGINT) AS n_bad FROM messy LIMIT 1"))
def _(spark, d):
    df = messy(spark, d).withColumn("gone", F.lit(None).cast("string"))
    return v.postconditions(df, [{"operation": "drop_empty_columns"}], "rid").select("step_index", "passed", "n_bad")


EMBED = "regexp_matches(amount, '(\\d+[\\.\\d]*\\s*[a-zA-Z]+|[a-zA-Z]+\\s*\\d+[\\.\\d]*)')::INT"


@query("audit_completeness",
       with_messy("").rstrip() + ", f AS (SELECT rid, coalesce(regexp_matches(amount, '[$€£¥₹]')::INT + starts_with(lower(trim(amount)), 'free')::INT "
       f"+ (lower(trim(amount)) = 'five')::INT + (trim(amount) = 'n/a')::INT + {EMBED}, 0) AS k, Progress, Finished, amount FROM messy), "
       "t AS (SELECT CAST(sum(k) AS BIGINT) AS n_flagged FROM f), "
       "a AS (SELECT count(*) AS touched FROM f WHERE NOT (Progress < 100 AND lower(Finished) NOT IN ('true', '1', 'yes')) AND "
       "(amount IS NULL OR TRY_CAST(amount AS DOUBLE) IS NULL)) "
       "SELECT n_flagged, least(touched, n_flagged) AS n_addressed, round(least(touched, n_flagged) / CAST(n_flagged AS DOUBLE), 4) AS completeness FROM t, a")
def _(spark, d):
    out = cleaned(spark, d)
    return v.audit_completeness(messy(spark, d), quality_flags(messy(spark, d), "rid"), out.audit)


# ---------------------------------------------------------------------------- versions


def after_cap(spark, d):
    return clean(messy(spark, d), "cap_extreme_values", "price", max_value=500000).drop("Finished").withColumn(
        "Progress", F.col("Progress").cast("string"))


@query("compare_columns",
       "SELECT * FROM (VALUES ('Finished', 'removed'), ('Progress', 'type changed'), ('amount', 'kept'), ('price', 'kept'), ('rid', 'kept'), "
       "('status', 'kept')) t(\"column\", change) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    return c.column_changes(messy(spark, d), after_cap(spark, d)).select("column", "change")


@query("compare_rows", with_messy("SELECT count(*) AS rows_before, count(amount) AS rows_after, CAST(0 AS BIGINT) AS rows_added, "
                                  "count(*) - count(amount) AS rows_removed FROM messy"))
def _(spark, d):
    return c.row_change(messy(spark, d), clean(messy(spark, d), "drop_null", "amount"))


@query("compare_drift",
       with_messy("").rstrip() + ", s AS (SELECT avg(price) AS bm, avg(price) FILTER (price <= 500000) AS am, stddev_samp(price) AS bs, "
       "stddev_samp(price) FILTER (price <= 500000) AS s2, avg((price IS NULL)::INT) * 100 AS bn, "
       "avg((price IS NULL OR price > 500000)::INT) * 100 AS an FROM messy) SELECT 'price' AS \"column\", round(bm, 2) AS before_mean, "
       "round(am, 2) AS after_mean, round(am - bm, 2) AS mean_shift, round((am - bm) / bm * 100, 4) AS pct_change, round(bs, 2) AS before_std, "
       "round(s2, 2) AS after_std, round(bn, 4) AS before_null_pct, round(an, 4) AS after_null_pct FROM s")
def _(spark, d):
    return rounded(c.drift(messy(spark, d), after_cap(spark, d)), 2, pct_change=4, before_null_pct=4, after_null_pct=4)


@query("compare_cells",
       with_messy("SELECT row_number() OVER (ORDER BY rid) - 1 AS row, 'status' AS \"column\", status AS before, trim(status) AS after FROM messy"))
def _(spark, d):
    return c.cell_changes(messy(spark, d), clean(messy(spark, d), "strip_whitespace", "status"), "rid")
