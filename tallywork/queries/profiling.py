"""Profiles, quality flags, suggestions, schemas and structural facts."""

from pyspark.sql import functions as F

from tallywork.operators import briefing as b
from tallywork.operators import profiling as p
from tallywork.operators import quality as q
from tallywork.operators import schema as s
from tallywork.operators.outliers import detection_fences, flag_outlier_cells
from tallywork.queries.base import messy, query, rounded, survey, table, with_messy, with_survey

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _profile_sql(numeric, texts, source):
    parts = []
    for c in numeric:
        parts.append(
            f"SELECT '{c}' AS \"column\", count(*) AS row_count, count(*) - count({c}) AS null_count, "
            f"round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count, "
            f"round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, CAST(min({c}) AS DOUBLE) AS min, "
            f"CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.25), 4) AS q25, "
            f"round(quantile_cont({c}, 0.75), 4) AS q75, round(quantile_cont({c}, 0.95), 4) AS p95, "
            f"round(quantile_cont({c}, 0.99), 4) AS p99, (SELECT round(quantile_cont(abs({c} - (SELECT quantile_cont({c}, 0.5) FROM {source})), 0.5), 4) "
            f"FROM {source}) AS mad, NULL AS avg_length, NULL AS max_length, NULL AS top FROM {source}")
    for c in texts:
        parts.append(
            f"SELECT '{c}', count(*), count(*) - count({c}), round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2), "
            f"count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(avg(length({c})), 2), "
            f"CAST(max(length({c})) AS INTEGER), (SELECT string_agg(concat({c}, ':', CAST(n AS STRING)), '|' ORDER BY n DESC, {c}) FROM "
            f"(SELECT {c}, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT 10)) FROM {source}")
    return " UNION ALL ".join(parts)


@query("column_profile", with_messy(_profile_sql(["rid", "price", "Progress"], ["amount", "status", "Finished"], "messy")))
def _(spark, d):
    out = p.column_profile(messy(spark, d)).withColumn(
        "top", F.expr("array_join(transform(top_values, s -> concat(s.value, ':', CAST(s.n AS STRING))), '|')"))
    return rounded(out.drop("top_values", "dtype", "min_date", "max_date"), 4, mean=3, std=3)


@query("column_profile_dates",
       "SELECT 'o_orderdate' AS \"column\", count(*) AS row_count, count(DISTINCT o_orderdate) AS unique_count, "
       "strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS max_date FROM orders")
def _(spark, d):
    return p.column_profile(table(spark, d, "orders").select("o_orderdate")).select(
        "column", "row_count", "unique_count", "min_date", "max_date")


@query("column_profile_lineitem")
def _(spark, d):
    return p.column_profile(table(spark, d, "lineitem")).drop("top_values")


# amounts of a survey export: the name "amount" makes it a numeric column there
FENCE = ("f AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM messy), "
         "p AS (SELECT a - 15 * (b - a) AS lo, b + 15 * (b - a) AS hi FROM f)")
EMBED = "'(\\d+[\\.\\d]*\\s*[a-zA-Z]+|[a-zA-Z]+\\s*\\d+[\\.\\d]*)'"


def _first(cond, k, value="amount"):
    return (f"(SELECT string_agg({value}, '|' ORDER BY rid) FROM (SELECT rid, {value} FROM messy WHERE {cond} ORDER BY rid LIMIT {k}))")


CURRENCY = "regexp_matches(amount, '[$€£¥]')"
FREE = "starts_with(lower(trim(amount)), 'free')"
WORDS = "lower(trim(amount)) IN ('five')"
VAGUE = "lower(trim(amount)) IN ('n/a')"
INCOMPLETE = "Progress < 100 AND lower(Finished) NOT IN ('true', '1', 'yes')"
FLAG_SQL = {
    "currency": f"SELECT 'amount' AS \"column\", 'currency' AS flag, count(*) AS n, {_first(CURRENCY, 4)} AS shown FROM messy WHERE {CURRENCY}",
    "free": f"SELECT 'amount' AS \"column\", 'free' AS flag, count(*) AS n, {_first(FREE, 3)} AS shown FROM messy WHERE {FREE}",
    "embedded_text": f"SELECT 'amount' AS \"column\", 'embedded_text' AS flag, count(*) AS n, (SELECT string_agg(amount, '|' ORDER BY rid) FROM "
                     f"(SELECT rid, amount FROM (SELECT rid, amount FROM messy WHERE regexp_matches(amount, {EMBED}) ORDER BY rid LIMIT 6) "
                     f"WHERE length(amount) < 35 ORDER BY rid LIMIT 4)) AS shown FROM messy WHERE regexp_matches(amount, {EMBED})",
    "number_words": f"SELECT 'amount' AS \"column\", 'number_words' AS flag, count(*) AS n, {_first(WORDS, 3)} AS shown FROM messy WHERE {WORDS}",
    "vague": f"SELECT 'amount' AS \"column\", 'vague' AS flag, count(*) AS n, {_first(VAGUE, 3)} AS shown FROM messy WHERE {VAGUE}",
    "incomplete_responses": f"SELECT 'Progress' AS \"column\", 'incomplete_responses' AS flag, count(*) AS n, "
                            f"{_first(INCOMPLETE, 20, 'CAST(rid AS STRING)').replace('SELECT rid, CAST(rid AS STRING)', 'SELECT rid')} AS shown FROM messy WHERE {INCOMPLETE}",
}


def shown(df):
    return df.select("column", "flag", "n", F.array_join("examples", "|").alias("shown"))


@query("quality_flags", with_messy("").rstrip() + f", {FENCE} " + " UNION ALL ".join(FLAG_SQL.values()) +
       " UNION ALL SELECT 'price', 'extreme_outliers', count(*), NULL FROM messy, p WHERE price < lo OR price > hi")
def _(spark, d):
    out = shown(q.quality_flags(messy(spark, d), "rid"))
    # the outlier examples would print a double as text
    return out.withColumn("shown", F.when(F.col("flag") != "extreme_outliers", F.col("shown")))


for _flag, _sql in FLAG_SQL.items():
    query(f"flag_{_flag}", with_messy(_sql))(
        lambda spark, d, flag=_flag: shown(q.one_flag(messy(spark, d), "rid", flag)))


@query("flag_extreme_outliers_detect", with_messy("").rstrip() + f", {FENCE} SELECT 'price' AS \"column\", count(*) AS n, "
       "round(any_value(lo), 5) AS lower_fence, round(any_value(hi), 5) AS upper_fence FROM messy, p WHERE price < lo OR price > hi")
def _(spark, d):
    out = q.one_flag(messy(spark, d), "rid", "extreme_outliers")
    return rounded(out.select("column", "n", "lower_fence", "upper_fence"), 5)


@query("flag_dirty_names", "SELECT unnest([' state', 'order  key']) AS \"column\", 'dirty_name' AS flag")
def _(spark, d):
    df = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias(" state"),
        F.col("o_custkey").alias("order  key"), F.col("o_orderpriority").alias("clean name"))
    return q.one_flag(df, "rid", "dirty_name").select("column", "flag")


@query("flag_empty_columns", "SELECT 'gone' AS \"column\", 'empty_column' AS flag, (SELECT count(*) FROM orders) > 0 AS read")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey AS rid", "CAST(NULL AS STRING) AS gone", "o_orderstatus")
    return q.one_flag(df, "rid", "empty_column").select("column", "flag", F.lit(True).alias("read"))


@query("flag_header_row", "SELECT 'header_row' AS flag, CAST(1 AS BIGINT) AS n FROM orders WHERE o_orderkey = 0")
def _(spark, d):
    text = "'Which of the following describes best how you answered question '"
    df = table(spark, d, "orders").selectExpr("o_orderkey AS rid", *[
        f"CASE WHEN o_orderkey = 0 THEN concat({text}, '{i}') ELSE o_orderpriority END AS q{i}" for i in range(4)])
    return q.one_flag(df, "rid", "header_row").select("flag", "n")


@query("detect_domain", "SELECT 'survey' AS messy_domain, CAST(NULL AS STRING) AS orders_domain FROM region LIMIT 1")
def _(spark, d):
    found = [q.detect_domain(messy(spark, d), "rid"), q.detect_domain(table(spark, d, "orders"), "o_orderkey")]
    return spark.createDataFrame([tuple(found)], "messy_domain string, orders_domain string")


@query("detection_fences", with_messy("").rstrip() + f", {FENCE} SELECT round(lo, 5) AS lower_fence, round(hi, 5) AS upper_fence FROM p")
def _(spark, d):
    lo, hi = detection_fences(messy(spark, d), {"price": F.col("price")})["price"]
    return rounded(spark.createDataFrame([(lo, hi)], "lower_fence double, upper_fence double"), 5)


@query("flag_outlier_cells", with_messy("").rstrip() + f", {FENCE}, x AS (SELECT rid, "
       "coalesce(TRY_CAST(amount AS DOUBLE), TRY_CAST(regexp_replace(amount, '[^\\d\\.\\-]', '', 'g') AS DOUBLE)) AS v FROM messy) "
       "SELECT rid, coalesce(v < 10 OR v > 400000, FALSE) AS is_outlier FROM x")
def _(spark, d):
    return flag_outlier_cells(messy(spark, d).select("rid", "amount"), "amount", (10.0, 400000.0)).drop("amount")


# -------------------------------------------------------------------------- suggestions


def constants(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS rid", "'same' AS fixed", "CAST(NULL AS STRING) AS gone", "o_custkey AS customer_id", "o_totalprice")


@query("suggest_drop", "SELECT * FROM (VALUES ('fixed', 'constant', 0.9::DOUBLE), ('gone', 'all null', 1.0::DOUBLE), "
       "('customer_id', 'id name', 0.7::DOUBLE)) t(\"column\", reason, confidence) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    return p.suggest_drop(constants(spark, d), "rid")


def typed(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey AS rid", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "CAST(o_custkey AS STRING) AS code",
        "o_orderpriority AS priority",
        "CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus) WHEN o_orderkey % 3 = 1 THEN concat(' ', o_orderstatus) ELSE o_orderstatus END AS state",
        "concat('user', CAST(o_custkey AS STRING), '@mail.example.com') AS contact",
        "concat('555-0', CAST(10 + o_custkey % 90 AS STRING), '-', CAST(1000 + o_custkey % 9000 AS STRING)) AS phone")


@query("suggest_type", "SELECT * FROM (VALUES ('day', 'datetime', 1.0::DOUBLE), ('code', 'numeric', 1.0::DOUBLE)) "
       "t(\"column\", suggested_type, confidence) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    return p.suggest_type(typed(spark, d), "rid")


@query("suggest_variants",
       "SELECT 'state' AS \"column\", lower(o_orderstatus) AS key, concat(' ', o_orderstatus, '/', o_orderstatus, '/', lower(o_orderstatus)) "
       "AS variants FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return p.suggest_variants(typed(spark, d), "rid").withColumn("variants", F.array_join("variants", "/"))


@query("detect_pii", "SELECT * FROM (VALUES ('contact', 'email', 100.0::DOUBLE), ('phone', 'phone', 100.0::DOUBLE)) "
       "t(\"column\", pii_type, match_pct) WHERE EXISTS (SELECT 1 FROM orders)")
def _(spark, d):
    return p.detect_pii(typed(spark, d), "rid")


@query("smart_suggestions",
       "SELECT * FROM (VALUES ('day', 'type', 'datetime', 1.0::DOUBLE), ('code', 'type', 'numeric', 1.0::DOUBLE), "
       "('contact', 'pii', 'email', 1.0::DOUBLE), ('phone', 'pii', 'phone', 1.0::DOUBLE)) t(\"column\", kind, detail, confidence) "
       "UNION ALL SELECT 'state', 'variants', concat(' ', o_orderstatus, ' / ', o_orderstatus, ' / ', lower(o_orderstatus)), NULL FROM orders GROUP BY o_orderstatus")
def _(spark, d):
    return p.smart_suggestions(typed(spark, d), "rid")


@query("infer_schema")
def _(spark, d):
    return s.infer_schema(messy(spark, d), "rid")


@query("infer_schema_orders",
       "SELECT 'o_custkey' AS \"column\", 'integer' AS type, FALSE AS nullable, FALSE AS \"unique\", CAST(min(o_custkey) AS DOUBLE) AS min, "
       "CAST(max(o_custkey) AS DOUBLE) AS max, NULL AS allowed, 'NOT NULL' AS constraints FROM orders UNION ALL "
       "SELECT 'o_totalprice', 'float', FALSE, count(DISTINCT o_totalprice) = count(*), min(o_totalprice), max(o_totalprice), NULL, "
       "CASE WHEN count(DISTINCT o_totalprice) = count(*) THEN 'NOT NULL, UNIQUE' ELSE 'NOT NULL' END FROM orders UNION ALL "
       "SELECT 'o_orderstatus', 'categorical', FALSE, FALSE, NULL, NULL, (SELECT string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) FROM orders), 'NOT NULL'")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    out = s.infer_schema(df, "o_orderkey")
    return out.select("column", "type", "nullable", "unique", "min", "max",
                      F.array_join("allowed_values", ",").alias("allowed"), "constraints")


DECLARED = [
    {"name": "rid", "type": "integer", "nullable": False, "min": 0, "max": 10**15},
    {"name": "amount", "type": "integer", "nullable": False},
    {"name": "price", "type": "float", "min": 0, "max": 500000},
    {"name": "status", "allowed_values": ["  F ", "  O "]},
    {"name": "absent", "type": "string"},
    {"name": "Progress", "type": "integer"},
]


@query("validate_schema",
       with_messy("SELECT 'null_violation' AS type, 'amount' AS \"column\", 'error' AS severity, count(*) FILTER (amount IS NULL) AS n FROM messy "
                  "UNION ALL SELECT 'type_mismatch', 'amount', 'warning', count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) FROM messy "
                  "UNION ALL SELECT 'range_violation', 'price', 'warning', count(*) FILTER (price < 0 OR price > 500000) FROM messy "
                  "UNION ALL SELECT 'value_violation', 'status', 'warning', count(*) FILTER (status NOT IN ('  F ', '  O ')) FROM messy "
                  "UNION ALL SELECT 'missing_column', 'absent', 'error', NULL UNION ALL SELECT 'extra_column', 'Finished', 'info', NULL"))
def _(spark, d):
    return s.validate_schema(messy(spark, d), DECLARED)


@query("discover_categories",
       "SELECT 'o_orderstatus' AS \"column\", string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS levels FROM orders "
       "UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").withColumn("free_text", F.concat(F.lit("order "), "o_orderkey"))
    return p.discover_categories(df).withColumn("levels", F.array_join("levels", ","))


@query("data_dictionary",
       with_messy("SELECT 'status' AS \"column\", 'string' AS dtype, 0.0::DOUBLE AS null_pct, count(DISTINCT status) AS unique_count, "
                  "(SELECT string_agg(status, ', ' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM messy GROUP BY 1)) AS top5, "
                  "NULL AS mean, NULL AS min, NULL AS max FROM messy UNION ALL SELECT 'price', 'double', "
                  "round((count(*) - count(price)) * 100.0::DOUBLE / count(*), 2), count(DISTINCT price), NULL, round(avg(price), 2), min(price), max(price) FROM messy"))
def _(spark, d):
    return rounded(p.data_dictionary(messy(spark, d).select("status", "price")), 2)


# ---------------------------------------------------------------------------- briefing


@query("weight_candidates",
       with_survey("SELECT 'weight_final' AS \"column\", CASE WHEN avg(w) BETWEEN 0.5 AND 2 THEN 'high' ELSE 'low' END AS confidence, count(*) AS n, "
                   "round(avg(w), 6) AS mean, min(w) AS minimum, max(w) AS maximum, round(sum(w), 4) AS total, FALSE AS integer_valued FROM survey "
                   "UNION ALL SELECT 'weight_kg', CASE WHEN avg(w) BETWEEN 0.5 AND 2 THEN 'moderate' ELSE 'low' END, count(*), "
                   "round(avg(w), 6), min(w), max(w), round(sum(w), 4), FALSE FROM survey"))
def _(spark, d):
    df = survey(spark, d).selectExpr("rid", "w AS weight_final", "w AS weight_kg", "y")
    return rounded(b.weight_candidates(df), 6, total=4)


@query("key_columns",
       "SELECT 'l_orderkey' AS \"column\", (SELECT count(*) FROM lineitem) AS rows, count(*) AS distinct, FALSE AS row_unique, "
       "max(n) AS max_rows_per_value, min(n) = max(n) AS uniform_repeat FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) "
       "UNION ALL SELECT 'case_id', (SELECT count(*) FROM lineitem), count(*), FALSE, max(n), min(n) = max(n) FROM "
       "(SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def _(spark, d):
    df = table(spark, d, "lineitem").selectExpr("l_orderkey AS l_orderkey", "l_suppkey AS case_id", "l_quantity")
    return b.key_columns(df.withColumnRenamed("l_orderkey", "order key")).withColumn(
        "column", F.when(F.col("column") == "order key", "l_orderkey").otherwise(F.col("column")))


@query("date_regularity",
       "WITH p AS (SELECT DISTINCT o_orderdate AS t FROM orders), g AS (SELECT t, date_diff('day', lag(t) OVER (ORDER BY t), t) AS gap FROM p) "
       "SELECT 'o_orderdate' AS \"column\", strftime(min(t), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(t), '%Y-%m-%dT%H:%M:%S') AS end, "
       "count(*) AS distinct, quantile_cont(gap, 0.5) AS median_gap_days, count(gap) >= 3 AND stddev_pop(gap) / avg(gap) <= 0.05 AS regular, "
       "count(*) < 8 AS too_sparse_for_trend FROM g")
def _(spark, d):
    return b.date_regularity(table(spark, d, "orders"))


@query("ordinal_columns",
       "SELECT 'l_linenumber' AS \"column\", 'integer_scale' AS kind, count(DISTINCT l_linenumber) AS levels, CAST(1 AS BIGINT) AS minimum, "
       "CAST(7 AS BIGINT) AS maximum FROM lineitem UNION ALL SELECT 'answer', 'labelled', count(DISTINCT l_returnflag), NULL, NULL FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").selectExpr(
        "l_linenumber", "l_quantity", "l_linestatus",
        "CASE l_returnflag WHEN 'A' THEN 'Agree' WHEN 'N' THEN 'Neutral' ELSE 'Disagree ' END AS answer")
    return b.ordinal_columns(df)


@query("numeric_shape",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count(*) AS n, round(skewness({c}), 5) AS skewness, round(kurtosis({c}), 5) AS excess_kurtosis, "
           f"CASE WHEN abs(skewness({c})) < 0.5 THEN 'symmetric' WHEN abs(skewness({c})) < 1 THEN 'moderately skewed' ELSE 'highly skewed' END AS shape, "
           f"round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share, '{k}' AS kind FROM lineitem"
           for c, k in [("l_quantity", "count"), ("l_extendedprice", "continuous"), ("l_discount", "continuous"), ("l_tax", "continuous")]))
def _(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return rounded(b.numeric_shape(df), 5, zero_share=6)


@query("group_levels",
       " UNION ALL ".join(
           f"SELECT '{c}' AS \"column\", count(*) AS levels, min(n) AS min_group_size, max(n) AS max_group_size, "
           f"min_by(v, (n, v)) AS smallest_level FROM (SELECT CAST({c} AS STRING) AS v, count(*) AS n FROM lineitem GROUP BY 1)"
           for c in ("l_linenumber", "l_returnflag", "l_linestatus")))
def _(spark, d):
    return b.group_levels(table(spark, d, "lineitem").select(
        "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_shipdate"))


@query("missingness",
       with_messy("").rstrip() + ", k AS (SELECT *, (amount IS NULL)::INT + (price IS NULL)::INT AS k FROM messy) SELECT c AS \"column\", "
       "round(CASE c WHEN 'amount' THEN avg((amount IS NULL)::INT) WHEN 'price' THEN avg((price IS NULL)::INT) ELSE 0 END, 6) AS null_rate, "
       "round(avg((k > 0)::INT), 6) AS incomplete_row_share, round(avg(k) FILTER (k > 0), 6) AS mean_missing_fields FROM k, "
       "(SELECT unnest(['amount', 'price', 'status']) AS c) GROUP BY c")
def _(spark, d):
    return rounded(b.missingness(messy(spark, d).select("amount", "price", "status")))


@query("low_information",
       "SELECT 'fixed' AS \"column\", 'near-constant' AS reason, count(*) AS n, CAST(1 AS BIGINT) AS distinct, 1.0::DOUBLE AS dominant_share FROM orders "
       "UNION ALL SELECT 'note', 'high-cardinality', count(*), count(*), round(1.0::DOUBLE / count(*), 8) FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "'same' AS fixed", "concat('note ', CAST(o_orderkey AS STRING)) AS note", "o_orderstatus", "o_totalprice")
    return rounded(b.low_information(df), 8)
