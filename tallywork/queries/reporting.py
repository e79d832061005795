"""Display tables and the streaming form of cleaning."""

from pyspark.sql import functions as F

from tallywork.operators import report, tables as t
from tallywork.queries.base import messy, query, table, with_messy
from tallywork.queries.sources import landing
from tallywork.streaming.cleaning_stream import clean_stream


@query("result_table",
       "SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 200")
def _(spark, d):
    days = table(spark, d, "orders").groupBy("o_orderdate").agg(F.count("*").alias("n")).orderBy("o_orderdate")
    return report.result_table(days)


@query("result_sizes", with_messy("SELECT count(price) AS n, count(*) - count(price) AS n_excluded FROM messy"))
def _(spark, d):
    kept, seen = report.observed(messy(spark, d), ["price"])
    t.describe(kept, ["price"]).count()
    kept.count()
    return spark.createDataFrame([(seen.get["n"], seen.get["n_excluded"])], "n long, n_excluded long")


STREAM = [
    {"operation": "strip_whitespace", "column": "status"},
    {"operation": "free_to_zero", "column": "amount"},
    {"operation": "remove_currency_symbols", "column": "amount"},
    {"operation": "remove_vague_entries", "column": "amount"},
    {"operation": "drop_null", "column": "amount"},
]


@query("clean_stream",
       with_messy("SELECT rid, trim(status) AS status, CASE WHEN starts_with(lower(amount), 'free') THEN '0' ELSE trim(replace(amount, '$', '')) END AS amount "
                  "FROM messy WHERE amount IS NOT NULL AND trim(amount) <> 'n/a'"))
def _(spark, d):
    # stage the derived rows as a directory of files, then run them through a stream
    source, sink, state = (f"{landing(spark)}/{part}" for part in ("in", "out", "state"))
    messy(spark, d).select("rid", "status", "amount").write.parquet(source)
    stream = spark.readStream.schema("rid long, status string, amount string").parquet(source)
    done = (
        clean_stream(stream, STREAM).writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    done.awaitTermination()
    return spark.read.parquet(sink)
