"""From raw documents to shards: five stages, each written as a Parquet table that the next one reads.

Every stage works on all rows its predecessor kept. Documents without words are kept by the filters (nothing
speaks against them); repeated rows (same id and text) are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywork.llm import cube_mix, decontamination, histogram_sort, jaccard_join, toxicity
from tallywork.llm.common import written
from tallywork.llm.queries import held_out, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = toxicity.score(docs.select(*COLUMNS), lexicon)
    return scored.where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles at 0.8."""
    own = docs.select(*COLUMNS)
    kept = jaccard_join.join(own, k=5, percent=80).where("kept").select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    keyed = own.withColumn("row", F.xxhash64("text"))
    found = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi")
    return found.dropDuplicates(["doc_id", "row"]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is part of a benchmark window."""
    told = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return told.where("not contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: sources near their target shares of all words."""
    own = docs.select(*COLUMNS)
    taken = cube_mix.mix(own).where("copies > 0").groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    sized = own.withColumn("size", cube_mix.words("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    found = sized.join(taken, on).select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return found.select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place in it of every document: 40 shards of equal bytes."""
    return histogram_sort.shard(docs.select(*COLUMNS), 40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
# Lexicon fit, sampling and splitters have no SQL. tests/llm compares near copies with all pairs here; the other
# stages are held only to properties (columns, ids, share kept, slots), their operators to tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
