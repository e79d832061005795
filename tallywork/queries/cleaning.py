"""Cleaning steps on the derived dirty table."""

from pyspark.sql import functions as F

from tallywork.operators.cleaning import clean
from tallywork.operators.outliers import Policy, outlier_mask
from tallywork.plans.cleaning_plan import run_cleaning
from tallywork.queries.base import messy, query, rounded, table, with_messy


@query("clean_column_names", 'SELECT o_orderkey AS "Order Key", o_orderstatus AS "State" FROM orders')
def _(spark, d):
    dirty = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("Order   Key "), F.col("o_orderstatus").alias(" State"))
    return clean(dirty, "clean_column_names")


@query("drop_empty_columns", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey", "CAST(NULL AS STRING) AS gone", "o_orderstatus")
    return clean(df, "drop_empty_columns", rid="o_orderkey")


@query("drop_incomplete_responses",
       with_messy("SELECT rid, Progress, Finished FROM messy WHERE NOT (Progress < 100 AND lower(Finished) "
                  "NOT IN ('true', '1', 'yes'))"))
def _(spark, d):
    return clean(messy(spark, d).select("rid", "Progress", "Finished"), "drop_incomplete_responses", rid="rid")


@query("drop_rows",
       with_messy("SELECT rid, amount FROM (SELECT rid, amount, row_number() OVER (ORDER BY rid) - 1 AS p "
                  "FROM messy WHERE amount IS NOT NULL) WHERE p NOT IN (0, 7, 500)"))
def _(spark, d):
    return run_cleaning(
        messy(spark, d).select("rid", "amount"),
        [{"operation": "drop_null", "column": "amount"},
         {"operation": "drop_rows", "params": {"indices": [0, 7, 500, 10**12]}}], "rid").df


CELL_SQL = {
    "strip_whitespace": "trim(amount)",
    "remove_currency_symbols": "trim(regexp_replace(amount, '[$€£¥₹]', '', 'g'))",
    "extract_number": "CASE WHEN regexp_matches(amount, '[0-9]') THEN CAST(CAST(replace(regexp_extract(amount, "
                      "'[-+]?\\d+(?:[,\\d]*)?(?:\\.\\d+)?', 0), ',', '') AS BIGINT) AS STRING) ELSE amount END",
    "convert_number_words": "CASE WHEN amount = 'one hundred twenty five' THEN '125' WHEN amount = 'Five' THEN '5' "
                            "ELSE amount END",
    "convert_time_to_number": "CASE WHEN regexp_matches(amount, '(?i)\\d+(\\.\\d+)?\\s*(hours?|hrs?|h|days?|d|minutes?|mins?|m|weeks?|wks?|w)') "
                              "THEN regexp_extract(amount, '(\\d+)', 1) ELSE amount END",
    "free_to_zero": "CASE WHEN starts_with(lower(trim(amount)), 'free') THEN '0' ELSE amount END",
    "remove_vague_entries": "CASE WHEN regexp_full_match(trim(amount), '(?i)(not\\s+much|very\\s+little|n/?a|none|nothing|"
                            "idk|unclear|unknown|not\\s+sure|not\\s+applicable|tbd|tbc|–|—|-|\\.\\.\\.?)') THEN NULL ELSE amount END",
    "sum_composite_expenses": "CASE WHEN len(regexp_extract_all(amount, '\\$?\\s*(\\d+(?:[,\\d]*)?(?:\\.\\d{1,2})?)', 1)) >= 2 THEN "
                              "CAST(CAST(list_sum(list_transform(regexp_extract_all(amount, '\\$?\\s*(\\d+(?:[,\\d]*)?(?:\\.\\d{1,2})?)', 1), "
                              "lambda x: CAST(replace(x, ',', '') AS BIGINT))) AS BIGINT) AS STRING) ELSE amount END",
}
for _op, _sql in CELL_SQL.items():
    query(_op, with_messy(f"SELECT rid, {_sql} AS amount FROM messy"))(
        lambda spark, d, op=_op: clean(messy(spark, d).select("rid", "amount"), op, "amount"))

FILL = {
    "mean": ("price", "round(coalesce(price, (SELECT avg(price) FROM messy)), 4)"),
    "median": ("price", "round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM messy)), 4)"),
    "mode": ("amount", "coalesce(amount, (SELECT amount FROM messy WHERE amount IS NOT NULL GROUP BY amount "
                       "ORDER BY count(*) DESC, amount LIMIT 1))"),
}
for _how, (_c, _sql) in FILL.items():
    query(f"fill_null_{_how}", with_messy(f"SELECT rid, {_sql} AS {_c} FROM messy"))(
        lambda spark, d, how=_how, c=_c: rounded(
            clean(messy(spark, d).select("rid", c), "fill_null", c, rid="rid", strategy=how), 4))


@query("drop_null", with_messy("SELECT rid, amount FROM messy WHERE amount IS NOT NULL"))
def _(spark, d):
    return clean(messy(spark, d).select("rid", "amount"), "drop_null", "amount", rid="rid")


@query("cast_type", with_messy("SELECT rid, TRY_CAST(amount AS BIGINT) AS amount, price FROM messy"))
def _(spark, d):
    # price has fractions, so asking for int leaves it alone
    return run_cleaning(messy(spark, d).select("rid", "amount", "price"), [
        {"operation": "cast_type", "column": "amount", "params": {"target_type": "int"}},
        {"operation": "cast_type", "column": "price", "params": {"target_type": "int"}}], "rid").df


@query("standardize_values",
       "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END "
       "AS o_orderstatus FROM orders")
def _(spark, d):
    return clean(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "standardize_values",
                 "o_orderstatus", mapping={"F": "final", "O": "open"})


@query("deduplicate",
       "SELECT min(o_orderkey) AS o_orderkey, o_custkey, o_orderpriority FROM orders GROUP BY o_custkey, o_orderpriority")
def _(spark, d):
    return clean(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "deduplicate",
                 rid="o_orderkey", subset=["o_custkey", "o_orderpriority"])


@query("rename_column_cleaning", "SELECT o_orderkey, o_orderstatus AS state FROM orders")
def _(spark, d):
    df = clean(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "rename_column",
               "o_orderstatus", new_name="state")
    return clean(df, "rename_column", "absent", new_name="ignored")


QUARTS = "(SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM messy)"


@query("remove_outliers",
       with_messy(f"SELECT rid, price FROM messy, {QUARTS} WHERE price >= q1 - 3 * (q3 - q1) AND price <= q3 + 3 * (q3 - q1)"))
def _(spark, d):
    return clean(messy(spark, d).select("rid", "price"), "remove_outliers", "price", rid="rid")


MAD = ("m AS (SELECT quantile_cont(price, 0.5) AS med FROM messy), "
       "a AS (SELECT quantile_cont(abs(price - med), 0.5) AS mad FROM messy, m)")


@query("flag_extreme_outliers",
       with_messy("").rstrip() + f", {MAD} SELECT rid, CASE WHEN 0.6745 * abs(price - med) / mad > 5 THEN NULL ELSE price END "
       "AS price, CASE WHEN 0.6745 * abs(price - med) / mad > 5 THEN 'OUTLIER:price' ELSE '' END AS _flagged FROM messy, m, a")
def _(spark, d):
    return clean(messy(spark, d).select("rid", "price"), "flag_extreme_outliers", "price", rid="rid")


@query("outlier_policy_mad",
       with_messy("").rstrip() + f", {MAD} SELECT rid, coalesce(0.6745 * abs(price - med) / mad > 3.5, FALSE) AS is_outlier "
       "FROM messy, m, a")
def _(spark, d):
    return outlier_mask(messy(spark, d).select("rid", "price"), "price", Policy("mad", 3.5)).drop("price")


@query("outlier_policy_iqr",
       with_messy(f"SELECT rid, coalesce(price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier "
                  f"FROM messy, {QUARTS}"))
def _(spark, d):
    return outlier_mask(messy(spark, d).select("rid", "price"), "price", Policy("iqr", 1.5)).drop("price")


@query("flag_contextual_fraud",
       with_messy("SELECT rid, amount, CASE WHEN TRY_CAST(amount AS DOUBLE) > 400000 THEN 'FRAUD:large order' ELSE '' END "
                  "AS _flagged FROM messy"))
def _(spark, d):
    return clean(messy(spark, d).select("rid", "amount"), "flag_contextual_fraud", "amount", rid="rid",
                 threshold=400000, reason="large order")


@query("cap_extreme_values",
       with_messy("SELECT rid, CASE WHEN price > 500000 THEN NULL ELSE price END AS price FROM messy"))
def _(spark, d):
    return clean(messy(spark, d).select("rid", "price"), "cap_extreme_values", "price", max_value=500000)


PLAN = [
    {"operation": "drop_incomplete_responses"},
    {"operation": "strip_whitespace", "column": "status"},
    {"operation": "free_to_zero", "column": "amount"},
    {"operation": "sum_composite_expenses", "column": "amount"},
    {"operation": "remove_currency_symbols", "column": "amount"},
    {"operation": "convert_number_words", "column": "amount"},
    {"operation": "remove_vague_entries", "column": "amount"},
    {"operation": "extract_number", "column": "amount"},
    {"operation": "drop_null", "column": "amount"},
    {"operation": "cast_type", "column": "amount", "params": {"target_type": "float"}},
    {"operation": "no_such_step", "column": "amount"},
    {"operation": "cap_extreme_values", "column": "price", "params": {"max_value": 500000}},
]
# the same plan in SQL, one CTE per group of steps
PLAN_SQL = """
, kept AS (SELECT * FROM messy WHERE NOT (Progress < 100 AND lower(Finished) NOT IN ('true', '1', 'yes'))),
s1 AS (SELECT rid, status, price, CASE WHEN starts_with(lower(trim(amount)), 'free') THEN '0' ELSE amount END AS a1,
  amount FROM kept),
s2 AS (SELECT *, CASE WHEN starts_with(a1, 'Item A') THEN CAST(CAST(regexp_extract(a1, '(\\d+)', 1) AS BIGINT) + 40 AS STRING)
  ELSE a1 END AS a2 FROM s1),
s3 AS (SELECT *, trim(replace(a2, '$', '')) AS a3 FROM s2),
s4 AS (SELECT *, CASE a3 WHEN 'one hundred twenty five' THEN '125' WHEN 'Five' THEN '5' ELSE a3 END AS a4 FROM s3),
s5 AS (SELECT *, CASE WHEN a4 = 'n/a' THEN NULL ELSE a4 END AS a5 FROM s4),
s6 AS (SELECT *, CASE WHEN a5 IS NULL THEN NULL ELSE regexp_extract(a5, '(\\d+)', 1) END AS a6 FROM s5)
"""


@query("cleaning_pipeline",
       with_messy("").rstrip() + PLAN_SQL + "SELECT rid, trim(status) AS status, CAST(a6 AS DOUBLE) AS amount, "
       "CASE WHEN price > 500000 THEN NULL ELSE price END AS price FROM s6 WHERE a6 IS NOT NULL")
def _(spark, d):
    return run_cleaning(messy(spark, d), PLAN, "rid").df.select("rid", "status", "amount", "price")


CHANGE = "SELECT rid + 1 AS \"row\", '{op}' AS operation, {old} AS original_value, {new} AS new_value FROM s6 WHERE {when}"
AUDIT = " UNION ALL ".join([
    "SELECT rid + 1 AS \"row\", 'drop_incomplete_responses' AS operation, concat('Progress=', CAST(Progress AS STRING)) "
    "AS original_value, '<dropped>' AS new_value FROM messy WHERE Progress < 100 AND lower(Finished) NOT IN ('true', '1', 'yes')",
    CHANGE.format(op="strip_whitespace", old="status", new="trim(status)", when="status <> trim(status)"),
    CHANGE.format(op="free_to_zero", old="amount", new="a1", when="amount <> a1"),
    CHANGE.format(op="sum_composite_expenses", old="a1", new="a2", when="a1 <> a2"),
    CHANGE.format(op="remove_currency_symbols", old="a2", new="a3", when="a2 <> a3"),
    CHANGE.format(op="convert_number_words", old="a3", new="a4", when="a3 <> a4"),
    CHANGE.format(op="remove_vague_entries", old="a4", new="a5", when="a4 IS NOT NULL AND a5 IS NULL"),
    CHANGE.format(op="extract_number", old="a5", new="a6", when="a5 <> a6"),
    CHANGE.format(op="drop_null", old="NULL", new="NULL", when="a6 IS NULL"),
])


@query("cell_audit", with_messy("").rstrip() + PLAN_SQL + AUDIT)
def _(spark, d):
    # the capped prices are left out: they would print a double as text
    return run_cleaning(messy(spark, d), PLAN[:-1], "rid").audit.select(
        "row", "operation", "original_value", "new_value")
