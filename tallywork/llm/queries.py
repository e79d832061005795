"""Registered queries of this folder, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywork.llm import (
    adaptive_rules, cube_mix, decontamination, histogram_sort, html_text, jaccard_join, langid, odd_sketch,
    periodic_runs, prefix_trie, suffix_dedup, toxicity, warc,
)
from tallywork.llm.common import take

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out():
    """Rows that no model may learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


@query("op1_cube_mix")
def op1(spark, sf_dir):
    out = cube_mix.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_histogram_sort")
def op2(spark, sf_dir):
    out = histogram_sort.shard(table(spark, sf_dir, "documents"), 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


@query("op3_language_filters")
def op3(spark, sf_dir):
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text", lang="lang")
    model = langid.learn(docs.where(~held_out()))
    return langid.identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op4_warc_round_trip")
def op4(spark, sf_dir):
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_toxicity_lexicon")
def op6(spark, sf_dir):
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~held_out()))
    out = toxicity.score(docs, lexicon)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_adaptive_rules")
def op7(spark, sf_dir):
    return adaptive_rules.judge(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8(spark, sf_dir):
    docs = take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_html_text")
def op9(spark, sf_dir):
    pages = take(table(spark, sf_dir, "pages"), page_id="page_id", html="html")
    return pages.select("page_id", html_text.text_of("html").alias("text"))


@query("op5_token_group_join")
def op5(spark, sf_dir):
    out = jaccard_join.join(table(spark, sf_dir, "documents"), k=4, percent=85)
    return out.select("doc_id", "n_shingles", "component_id")


@query("op10_suffix_dedup")
def op10(spark, sf_dir):
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie")
def op11(spark, sf_dir):
    turns = take(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    return prefix_trie.trie(turns, base=F.col("conv_id") - F.col("conv_id") % 20, head=crc % 4)


@query("op12_odd_sketch")
def op12(spark, sf_dir):
    out = odd_sketch.near_copies(table(spark, sf_dir, "documents"), k=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def looped(docs: DataFrame) -> DataFrame:
    """Every tenth text (by the id's checksum) repeats a stretch of its words up to its end."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(crc % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, g = F.size("words"), F.floor(crc / 10)
    cut = docs.select("doc_id", "text", words.alias("words")).withColumn("n", n)
    cut = cut.withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), rest)), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = looped(take(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
    found = periodic_runs.collapse(docs, least=6, times=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    told = found.withColumn("longest", longest)
    length, start, period = F.col("longest")["length"], -F.col("longest")["col2"], -F.col("longest")["col3"]
    lines = F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return told.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
