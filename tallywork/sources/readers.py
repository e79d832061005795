"""Readers for the supported file kinds, and the checks made while reading."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywork.functions import fixed
from tallywork.functions.cells import is_date, is_number, quoted, text, timestamp

TEXT_EXTENSIONS = [".csv", ".tsv", ".tab", ".txt"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing everywhere in this package; this makes it so for other tools."""
    floating = {
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floating else quoted(c)
            for c in df.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str, schema=None, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """Header row; types inferred unless a schema is given (give one for large inputs).

    A file whose cells hold line breaks cannot be split; where they do not, say
    ``multi_line=False`` and Spark reads one large file in many tasks.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    reader = reader.option("multiLine", multi_line).option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = True) -> DataFrame:
    """Array of records, or one record per line with ``multi_line=False``."""
    reader = spark.read.option("multiLine", multi_line)
    reader = reader.schema(schema) if schema else reader
    return nan_to_null(reader.json(path))


def read_parquet(spark: SparkSession, path: str, nan_as_null: bool = False) -> DataFrame:
    """The operators skip NaN themselves; rewriting it here would keep filters from the scan."""
    df = spark.read.parquet(path)
    return nan_to_null(df) if nan_as_null else df


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Pick the reader by extension; anything unknown is read as CSV."""
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext in ("tsv", "tab"):
        return read_tsv(spark, path, schema)
    if ext == "json":
        return read_json(spark, path, schema)
    if ext == "parquet":
        return read_parquet(spark, path)
    return read_csv(spark, path, schema)


def parse_date_named_columns(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Turn date-named text columns into timestamps when enough of ALL rows parse."""
    wanted = [
        f.name
        for f in df.schema
        if re.search(fixed.DATE_NAME, f.name, re.I)
        and not is_number(f.dataType) and not is_date(f.dataType)
    ]
    if not wanted:
        return df
    parsed = df.agg(
        *[F.avg(timestamp(quoted(c)).isNotNull().cast("double")).alias(c) for c in wanted]
    ).first()
    keep = {c for c in wanted if (parsed[c] or 0.0) >= share}
    return df.select(
        *[timestamp(quoted(c)).alias(c) if c in keep else quoted(c) for c in df.columns]
    )


def _first_bytes(batches):
    """Size and first four bytes of each listed file."""
    from pyarrow import fs

    for batch in batches:
        heads, sizes = [], []
        for uri in batch["path"]:
            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_file(path) as handle:
                sizes.append(handle.size())
                heads.append(handle.read(4))
        yield batch.assign(length=sizes, head=heads)


def content_check(spark: SparkSession, directory: str) -> DataFrame:
    """One verdict per file: do the first bytes fit the extension?

    The names come from Spark's file listing (a scan would leave out empty files); the
    files are opened in tasks.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    names = [(re.sub("^file:/+", "file:///", p),) for p in listing.inputFiles()]
    tasks = min(len(names), spark.sparkContext.defaultParallelism * 4) or 1
    files = spark.createDataFrame(names, "path string").repartition(tasks)
    heads = files.mapInPandas(_first_bytes, "path string, length long, head binary")
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    head = F.hex("head")
    return heads.select(
        "path",
        ext.alias("extension"),
        F.col("length").alias("n_bytes"),
        F.when(F.col("length") == 0, False)
        .when(ext.isin(TEXT_EXTENSIONS), True)
        .when(ext == ".parquet", head == "50415231")
        .when(ext == ".json", head.startswith("7B") | head.startswith("5B"))
        .when(ext == ".xlsx", head == "504B0304")
        .when(ext == ".xls", head == "D0CF11E0")
        .otherwise(True)
        .alias("valid"),
    )


def sample_records(df: DataFrame, n: int = 5, marker: str = "<null>") -> DataFrame:
    """First rows as text, with missing cells told apart from empty ones."""
    return df.limit(n).select(
        *[F.coalesce(text(quoted(c)), F.lit(marker)).alias(c) for c in df.columns]
    )


def effective_version(datasets: DataFrame, runs: DataFrame) -> DataFrame:
    """Newest completed run that was not reverted and has an output, else the original key.

    ``datasets``: dataset_id, file_key. ``runs``: dataset_id, status, reverted, output_key,
    created_at.
    """
    usable = runs.where(
        (F.col("status") == "completed") & ~F.col("reverted") & F.col("output_key").isNotNull()
    )
    newest = usable.groupBy("dataset_id").agg(
        F.max_by("output_key", F.struct("created_at", "output_key")).alias("_newest")
    )
    return datasets.join(newest, "dataset_id", "left").select(
        "dataset_id", F.coalesce("_newest", "file_key").alias("effective_key")
    )
