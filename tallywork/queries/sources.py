"""Scans, sinks, row filters and table edits."""

import os

from pyspark.sql import functions as F

from tallywork.operators import manipulate as m
from tallywork.operators import tables as t
from tallywork.plans.edits import preview_edits, run_edits
from tallywork.queries.base import messy, query, rounded, table, with_messy
from tallywork.session import shared_folder
from tallywork.sources import readers, writers


def landing(spark) -> str:
    """A fresh shared folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/tallywork-{os.urandom(8).hex()}"


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"
KEPT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
KEPT_SCHEMA = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderpriority string"
)


@query("read_parquet", "SELECT * EXCLUDE (l_shipdate) FROM lineitem")
def _(spark, d):
    return readers.read_parquet(spark, f"{d}/lineitem.parquet").drop("l_shipdate")


@query("read_csv", ORDERS)
def _(spark, d):
    path = landing(spark) + "/orders.csv"
    writers.write_csv(table(spark, d, "orders"), path, KEPT)
    return readers.read_table(spark, path)


@query("read_tsv", ORDERS)
def _(spark, d):
    path = landing(spark) + "/orders.tsv"
    table(spark, d, "orders").select(*KEPT).write.csv(path, sep="\t", header=True)
    return readers.read_table(spark, path, KEPT_SCHEMA)


@query("read_json", ORDERS)
def _(spark, d):
    path = landing(spark) + "/orders.json"
    writers.write_json(table(spark, d, "orders"), path, KEPT)
    return readers.read_json(spark, path, multi_line=False).select(*KEPT)


@query("write_csv", "SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM "
       "(SELECT lang, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN concat('''', text) "
       "ELSE text END AS text FROM documents) GROUP BY lang")
def _(spark, d):
    path = landing(spark) + "/documents.csv"
    writers.write_csv(table(spark, d, "documents"), path, ["doc_id", "lang", "text"])
    back = readers.read_csv(spark, path, "doc_id long, lang string, text string")
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("write_json", "SELECT conv_id, turn, role, text FROM conversations")
def _(spark, d):
    path = landing(spark) + "/conversations.json"
    writers.write_json(table(spark, d, "conversations"), path)
    return readers.read_json(
        spark, path, "conv_id long, turn long, role string, text string", multi_line=False
    )


@query("write_parquet", "SELECT doc_id, quality FROM labels")
def _(spark, d):
    path = landing(spark) + "/labels.parquet"
    writers.write_parquet(table(spark, d, "labels"), path, ["doc_id", "quality"])
    return readers.read_table(spark, path)


@query(
    "parse_date_named_columns",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderstatus AS state_day "
    "FROM orders",
)
def _(spark, d):
    dated = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("order_date"),
        F.col("o_orderstatus").alias("state_day"),
    )
    parsed = readers.parse_date_named_columns(dated)
    return parsed.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@query("ingest_content_check", "SELECT concat(unnest(" + str(TABLES) + "), '.parquet') AS file, '.parquet' AS extension, TRUE AS valid, TRUE AS filled")
def _(spark, d):
    checked = readers.content_check(spark, d)
    return checked.select(
        F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "extension", "valid", (F.col("n_bytes") > 0).alias("filled"))


@query(
    "sample_records",
    with_messy("SELECT coalesce(amount, '<null>') AS amount, status, CAST(rid AS STRING) AS rid "
               "FROM messy ORDER BY messy.rid LIMIT 50"),
)
def _(spark, d):
    return readers.sample_records(messy(spark, d).orderBy("rid").select("amount", "status", "rid"), 50)


@query(
    "preview_page",
    with_messy("SELECT rid, amount, round(price, 2) AS price, CASE WHEN amount IS NULL THEN 'amount:null' "
               "ELSE '' END AS notes FROM messy WHERE regexp_matches(status, '(?i)f') "
               "ORDER BY amount DESC NULLS LAST, rid LIMIT 50 OFFSET 100"),
)
def _(spark, d):
    page = m.preview_page(
        messy(spark, d).select("rid", "amount", "price", "status").fillna(0.0, ["price"]), "rid",
        page=3, sort_by="amount", sort_desc=True, filter_column="status", filter_value="f",
    )
    return page.select(
        "rid", "amount", F.round(F.expr("nullif(price, 0.0)"), 2).alias("price"),
        F.array_join("_annotations", ";").alias("notes"),
    )


@query(
    "neutralize_formulas",
    "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat('''=', lang) WHEN doc_id % 5 = 1 "
    "THEN concat('''@', source) ELSE lang END AS cell, n_chars FROM documents",
)
def _(spark, d):
    risky = table(spark, d, "documents").selectExpr(
        "doc_id", "CASE WHEN doc_id % 5 = 0 THEN concat('=', lang) WHEN doc_id % 5 = 1 "
        "THEN concat('@', source) ELSE lang END AS cell", "n_chars")
    return writers.neutralize_formulas(risky)


@query(
    "pick_effective_version",
    "SELECT c_custkey AS dataset_id, coalesce(max(k), concat('file-', CAST(c_custkey AS STRING))) AS effective_key "
    "FROM customer LEFT JOIN (SELECT o_custkey, concat('out-', CAST(max(o_orderkey) AS STRING)) AS k "
    "FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND o_orderkey % 3 <> 0 "
    "GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_custkey",
)
def _(spark, d):
    datasets = table(spark, d, "customer").selectExpr(
        "c_custkey AS dataset_id", "concat('file-', CAST(c_custkey AS STRING)) AS file_key")
    runs = table(spark, d, "orders").selectExpr(
        "o_custkey AS dataset_id",
        "CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status",
        "o_orderpriority = '5-LOW' AS reverted",
        "CASE WHEN o_orderkey % 3 <> 0 THEN concat('out-', CAST(o_orderkey AS STRING)) END AS output_key",
        "o_orderkey AS created_at")
    return readers.effective_version(datasets, runs)


# ---------------------------------------------------------------------------- filters

PRED_SQL = {
    "==": "status = '  F '", "!=": "amount <> '40' OR amount IS NULL",
    ">": "TRY_CAST(amount AS DOUBLE) > 250000", ">=": "price >= 250000",
    "<": "price < 1000", "<=": "TRY_CAST(amount AS DOUBLE) <= 250000",
    "contains": "regexp_matches(amount, '(?i)item a|hours')",
    "not_contains": "amount IS NULL OR NOT regexp_matches(amount, '(?i)item a|hours')",
    "is_null": "amount IS NULL", "is_not_null": "amount IS NOT NULL",
}
PRED = {
    "==": ("status", "  F "), "!=": ("amount", "40"), ">": ("amount", 250000),
    ">=": ("price", 250000), "<": ("price", "1000"), "<=": ("amount", 250000),
    "contains": ("amount", "Item A|HOURS"), "not_contains": ("amount", "Item A|HOURS"),
    "is_null": ("amount", None), "is_not_null": ("amount", None),
}
PRED_UNION = with_messy(" UNION ALL ".join(
    f"SELECT '{op}' AS op, rid FROM messy WHERE {cond}" for op, cond in PRED_SQL.items()))


def _every_operator(spark, d, keep):
    out = None
    for op, (column, value) in PRED.items():
        part = keep(messy(spark, d), column, op, value).select(F.lit(op).alias("op"), "rid")
        out = part if out is None else out.unionByName(part)
    return out


query("analysis_filter", PRED_UNION)(lambda spark, d: _every_operator(spark, d, t.analysis_filter))
query("filter_rows", PRED_UNION)(lambda spark, d: _every_operator(spark, d, m.filter_rows))


# ------------------------------------------------------------------------------ edits

PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


@query("delete_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def _(spark, d):
    return m.delete_columns(table(spark, d, "part"), ["p_name", "p_type", "p_retailprice"])


@query("rename_column", "SELECT p_partkey AS part_id, p_name FROM part")
def _(spark, d):
    return m.rename_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey", "part_id")


@query("add_column",
       "SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS total, concat(l_returnflag, '/', "
       "l_linestatus) AS flags, 'x' AS tag FROM lineitem")
def _(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    df = m.add_column(df, "total", source_columns=["l_quantity", "l_tax"])
    df = m.add_column(df, "flags", source_columns=["l_returnflag", "l_linestatus"],
                      operation="concat", separator="/")
    df = m.add_column(df, "tag", default_value="x")
    return rounded(df.select("l_orderkey", "l_linenumber", "total", "flags", "tag"))


@query("merge_columns",
       with_messy("SELECT rid, CASE WHEN amount IS NULL THEN NULL ELSE concat(amount, ' | ', Finished) END "
                  "AS merged FROM messy"))
def _(spark, d):
    df = messy(spark, d).select("rid", "amount", "Finished")
    return m.merge_columns(df, ["amount", "Finished"], "merged", " | ", drop_originals=True)


@query("format_column",
       "SELECT o_orderkey, format('${:,.2f}', o_totalprice) AS money, format('{:.1f}%', CAST(o_custkey AS DOUBLE)) "
       "AS pct, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS whole, lower(o_orderpriority) AS low, "
       "upper(o_orderstatus) AS up, trim(concat('  ', o_orderstatus, ' ')) AS bare FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_totalprice AS money", "o_custkey AS pct", "o_totalprice AS whole",
        "o_orderpriority AS low", "o_orderstatus AS up", "concat('  ', o_orderstatus, ' ') AS bare")
    for column, kind in [("money", "currency"), ("pct", "percentage"), ("whole", "integer"),
                         ("low", "lowercase"), ("up", "uppercase"), ("bare", "trim")]:
        df = m.format_column(df, column, kind)
    return df


@query("format_column_titlecase",
       "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' "
       "WHEN '3-MEDIUM' THEN '3-Medium' WHEN '4-NOT SPECIFIED' THEN '4-Not Specified' ELSE '5-Low' END "
       "AS priority FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority AS priority")
    return m.format_column(df, "priority", "titlecase")


@query("move_column", "SELECT * FROM part")
def _(spark, d):
    return m.move_column(table(spark, d, "part"), "p_size", after="p_partkey")


@query("reorder_columns", "SELECT * FROM part")
def _(spark, d):
    return m.reorder_columns(table(spark, d, "part"), ["p_size", "p_name"])


@query("split_column",
       "SELECT o_orderkey, trim(split_part(o_orderpriority, '-', 1)) AS priority_1, "
       "trim(split_part(o_orderpriority, '-', 2)) AS priority_2 FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority AS priority")
    return m.split_column(df, "priority", "-", drop_original=True)


@query("cast_type_edit",
       with_messy("SELECT rid, TRY_CAST(amount AS BIGINT) AS amount, CAST(Progress AS STRING) AS Progress, "
                  "CAST(rid AS DOUBLE) AS as_float FROM messy"))
def _(spark, d):
    df = messy(spark, d).select("rid", "amount", "Progress", F.col("rid").alias("as_float"))
    df = m.cast_type(df, "amount", "int")
    return m.cast_type(m.cast_type(df, "Progress", "str"), "as_float", "float")


@query("cast_type_datetime",
       "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice > 0 AS paid FROM orders")
def _(spark, d):
    df = table(spark, d, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'MM/dd/yyyy') AS day", "o_totalprice AS paid")
    df = m.cast_type(m.cast_type(df, "day", "datetime"), "paid", "bool")
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


EDITS = [
    {"op_type": "filter_rows", "params": {"column": "price", "operator": "is_not_null"}},
    {"op_type": "format_column", "params": {"column": "status", "format_type": "trim"}},
    {"op_type": "rename_column", "params": {"old_name": "Finished", "new_name": "done"}},
    {"op_type": "fill_nulls", "params": {"column": "amount", "value": "missing"}},
    {"op_type": "drop_duplicates", "params": {"columns": ["amount", "status"], "keep": "first"}},
    {"op_type": "delete_columns", "params": {"columns": ["price", "Progress"]}},
]


@query("manipulation_pipeline",
       with_messy("SELECT rid, amount, status, done FROM (SELECT rid, coalesce(amount, 'missing') AS amount, "
                  "trim(status) AS status, Finished AS done, row_number() OVER (PARTITION BY "
                  "coalesce(amount, 'missing'), trim(status) ORDER BY rid) AS k FROM messy "
                  "WHERE price IS NOT NULL) WHERE k = 1"))
def _(spark, d):
    return run_edits(messy(spark, d), EDITS, rid="rid")


@query("manipulation_preview",
       with_messy("SELECT count(*) AS rows_before, count(price) AS rows_after, "
                  "count(price) - count(*) AS row_change, CASE WHEN count(price) < count(*) THEN 1 ELSE 0 END "
                  "+ count(DISTINCT CASE WHEN Finished IS NOT NULL THEN 1 END) AS n_warnings FROM messy"))
def _(spark, d):
    seen = preview_edits(messy(spark, d), EDITS[:3], rid="rid")
    # one warning names the rows that go, one the column that is renamed away
    return spark.createDataFrame(
        [(seen["rows_before"], seen["rows_after"], seen["row_change"], len(seen["warnings"]))],
        "rows_before long, rows_after long, row_change long, n_warnings int")


# ----------------------------------------------------------- sorts, limits, null filling


@query("sort", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC NULLS LAST")
def _(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return m.sort(df, "o_totalprice", ascending=False, rid="o_orderkey")


def _dedup_sql(order, extra=""):
    return ("SELECT o_orderkey, o_custkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY "
            f"o_custkey, o_orderpriority ORDER BY o_orderkey {order}) AS k, count(*) OVER (PARTITION BY "
            f"o_custkey, o_orderpriority) AS n FROM orders) WHERE k = 1 {extra}")


for _keep, _sql in (("first", _dedup_sql("ASC")), ("last", _dedup_sql("DESC")),
                    (False, _dedup_sql("ASC", "AND n = 1"))):
    query(f"drop_duplicates_{_keep or 'none'}", _sql)(
        lambda spark, d, keep=_keep: m.drop_duplicates(
            table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
            "o_orderkey", ["o_custkey", "o_orderpriority"], keep))

FILLS = {
    "mean": "coalesce(price, (SELECT avg(price) FROM messy))",
    "median": "coalesce(price, (SELECT quantile_cont(price, 0.5) FROM messy))",
    "value": "coalesce(price, -1)",
}
for _how, _sql in FILLS.items():
    query(f"fill_nulls_{_how}", with_messy(f"SELECT rid, round({_sql}, 4) AS price FROM messy"))(
        lambda spark, d, how=_how: rounded(m.fill_nulls(
            messy(spark, d).select("rid", "price"), "price",
            **({"value": -1} if how == "value" else {"method": how})), 4))


@query("fill_nulls_mode",
       with_messy("SELECT rid, coalesce(amount, (SELECT amount FROM messy WHERE amount IS NOT NULL GROUP BY amount "
                  "ORDER BY count(*) DESC, amount LIMIT 1)) AS amount FROM messy"))
def _(spark, d):
    return m.fill_nulls(messy(spark, d).select("rid", "amount"), "amount", method="mode")


for _how, _over in (("ffill", "ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
                    ("bfill", "ORDER BY rid DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")):
    query(f"fill_nulls_{_how}",
          with_messy(f"SELECT rid, last_value(amount IGNORE NULLS) OVER ({_over}) AS amount FROM messy"))(
        lambda spark, d, how=_how: m.fill_nulls(
            messy(spark, d).select("rid", "amount"), "amount", method=how, rid="rid"))


@query("stamp_rid", "SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, "
       "CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders")
def _(spark, d):
    from tallywork.operators.ordering import stamp_rid

    return stamp_rid(table(spark, d, "orders")).agg(
        F.count_distinct("_rid").alias("n"), F.min("_rid").alias("lo"), F.max("_rid").alias("hi"),
        F.sum("_rid").alias("total"))
