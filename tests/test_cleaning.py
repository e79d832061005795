"""Cleaning steps, audit, edits, flags and readers on small frames."""

import pytest
from pyspark.sql import functions as F

from tallywork.errors import Refusal
from tallywork.operators import manipulate as m
from tallywork.operators import quality as q
from tallywork.operators import profiling as p
from tallywork.operators import verify as v
from tallywork.operators.cleaning import STEPS, clean
from tallywork.operators.combine import join_tables
from tallywork.operators.outliers import Policy, outlier_mask
from tallywork.operators.tables import analysis_filter, histogram, resample, top_n
from tallywork.plans.cleaning_plan import run_cleaning
from tallywork.plans.edits import EDITS, preview_edits, run_edits
from tallywork.sources import readers, writers
from tallywork.streaming.cleaning_stream import clean_stream


def column(spark, values):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], "rid long, c string")


def values(df):
    return [r["c"] for r in df.orderBy("rid").collect()]


CELLS = {
    "strip_whitespace": ([" a ", "b\t", None, " "], ["a", "b", None, ""]),
    "remove_currency_symbols": (["$1,200", "€ 5", "₹7", "x", None], ["1,200", "5", "7", "x", None]),
    "extract_number": (["about 1,250 km", "-3.50", "+7", "none", "007", None], ["1250", "-3.5", "7", "none", "7", None]),
    "convert_number_words": (
        ["Five", "two hundred five", "one thousand two hundred", "ninety nine", "hundred", "some one", "bone", None],
        ["5", "205", "1200", "99", "100", "1", "bone", None]),
    "convert_time_to_number": (["2 hours", "1h 30m", "1.5 days", "90 MINS", "soon"], ["2", "1", "1.5", "90", "soon"]),
    "free_to_zero": (["Free", " free (comp)", "not free", None], ["0", "0", "not free", None]),
    "remove_vague_entries": (["N/A", " idk ", "-", "...", "..", "unknown", "some", "nothing much"],
                             [None, None, None, None, None, None, "some", "nothing much"]),
    "sum_composite_expenses": (["Item A - $150, Item B $300, Item C $300", "$40", "2.50 and 1.25", "x"],
                               ["750", "$40", "3.75", "x"]),
}


@pytest.mark.parametrize("step", CELLS)
def test_cell_steps(spark, step):
    before, after = CELLS[step]
    assert values(clean(column(spark, before), step, "c")) == after


def test_steps_skip_missing_columns(spark):
    df = column(spark, ["a"])
    for step in STEPS:
        if step not in ("clean_column_names", "drop_empty_columns", "deduplicate", "drop_rows"):
            assert clean(df, step, "absent", rid="rid").count() == 1


def test_audit_skips_pure_type_changes(spark):
    out = run_cleaning(column(spark, ["80", "$90", None]), [
        {"operation": "remove_currency_symbols", "column": "c"},
        {"operation": "cast_type", "column": "c", "params": {"target_type": "float"}},
        {"operation": "fill_null", "column": "c", "params": {"value": 1}},
        {"operation": "rename_column", "column": "c", "params": {"new_name": "d"}},
    ], "rid")
    audit = sorted(tuple(r)[:5] for r in out.audit.collect())
    assert audit == [(2, "c", "$90", "90", "remove_currency_symbols"), (3, "c", None, "1.0", "fill_null")]
    assert out.df.columns == ["rid", "d"] and not out.failed


def test_failing_steps_are_recorded_and_skipped(spark):
    out = run_cleaning(column(spark, ["a", "a"]), [
        {"operation": "nope", "column": "c"},
        {"operation": "deduplicate", "params": {"subset": ["absent"]}},
        {"operation": "fill_null", "column": "c", "params": {"bogus": 1}},
        {"operation": "deduplicate", "params": {"subset": ["c"]}},
    ], "rid")
    assert [f["step_index"] for f in out.failed] == [0, 1, 2]
    assert out.df.count() == 1 and out.audit.collect()[0]["row"] == 2


def test_drop_rows_counts_in_the_current_frame(spark):
    out = run_cleaning(column(spark, [None, "a", "b", None, "c"]), [
        {"operation": "drop_null", "column": "c"},
        {"operation": "drop_rows", "params": {"indices": [0, 2, 99, -1]}}], "rid")
    assert values(out.df) == ["b"]
    assert sorted(r["row"] for r in out.audit.where("operation = 'drop_rows'").collect()) == [2, 5]


def test_long_plan_stays_linear(spark):
    import time

    steps = [{"operation": s, "column": "c"} for s in list(CELLS) * 3] + [{"operation": "drop_null", "column": "c"}]
    begin = time.time()
    out = run_cleaning(column(spark, ["$5 ", None, "x"]), steps, "rid")
    assert out.df.count() == 2 and out.audit.count() >= 1
    assert time.time() - begin < 60


def test_outlier_policies(spark):
    data = [float(x) for x in (10, 11, 12, 10, 11, 12, 11, 500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "rid long, x double")
    flagged = lambda policy, t=None: [r["x"] for r in outlier_mask(df, "x", policy, t).where("is_outlier").collect()]
    assert flagged(Policy()) == [500.0]
    assert flagged(Policy("iqr", 3.0)) == [500.0]
    assert flagged(Policy("none")) == []
    assert flagged(Policy(), 10_000) == []
    flat = spark.createDataFrame([(i, 5.0) for i in range(9)] + [(9, 6.0)], "rid long, x double")
    assert outlier_mask(flat, "x").where("is_outlier").count() == 1  # no spread: extreme percentiles
    with pytest.raises(Refusal):
        Policy("weird")


def test_flags_add_up_in_one_column(spark):
    rows = [(i, str(x)) for i, x in enumerate([10, 11, 12, 10, 11, 900, "word"])]
    df = spark.createDataFrame(rows, "rid long, c string")
    out = run_cleaning(df, [
        {"operation": "flag_contextual_fraud", "column": "c", "params": {"threshold": 500, "reason": "big"}},
        {"operation": "flag_extreme_outliers", "column": "c"}], "rid").df
    got = {r["rid"]: (r["c"], r["_flagged"]) for r in out.collect()}
    assert got[5] == (None, "FRAUD:bigOUTLIER:c")
    assert got[6] == (None, "") and got[0] == (10.0, "")  # coerced: text is lost, as documented


def test_remove_outliers_also_drops_missing_rows_quietly(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 3.0, 2.0, 1000.0, None])], "rid long, x double")
    out = run_cleaning(df, [{"operation": "remove_outliers", "column": "x"}], "rid")
    assert out.df.count() == 4 and [r["row"] for r in out.audit.collect()] == [5]


# ------------------------------------------------------------------------------- edits


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [(0, "ann lee", 30, 1.5, "x, y"), (1, "o'neil", 41, None, None), (2, "bob", 30, -1234.5, "z"), (3, "bob", 30, -1234.5, "z")],
        "rid long, name string, age int, score double, city string")


def test_formats(people):
    show = lambda c, f: [r[c] for r in m.format_column(people, c, f).orderBy("rid").collect()]
    assert show("score", "currency") == ["$1.50", "", "$-1,234.50", "$-1,234.50"]
    assert show("score", "percentage")[:2] == ["1.5%", ""]
    assert show("score", "integer")[:3] == ["1", "", "-1234"]
    assert show("name", "titlecase")[:2] == ["Ann Lee", "O'Neil"]
    with pytest.raises(Refusal):
        m.format_column(people, "name", "shout")


def test_split_and_dedupe_and_cast(people):
    split = m.split_column(people, "city")
    assert [(r["city_1"], r["city_2"]) for r in split.orderBy("rid").collect()][:3] == [("x", "y"), (None, None), ("z", None)]
    assert m.drop_duplicates(people, "rid").count() == 3
    assert {r["rid"] for r in m.drop_duplicates(people, "rid", ["name"], "last").collect()} == {0, 1, 3}
    assert {r["rid"] for r in m.drop_duplicates(people, "rid", ["name"], False).collect()} == {0, 1}
    with pytest.raises(Refusal, match="fractions"):
        m.cast_type(people, "score", "int")


def test_pipeline_is_fail_fast_with_a_step_number(people):
    with pytest.raises(Refusal, match="Step 2"):
        run_edits(people, [{"op_type": "delete_columns", "params": {"columns": ["city"]}},
                           {"op_type": "delete_columns", "params": {"columns": ["city"]}}])
    seen = preview_edits(people, [{"op_type": "filter_rows", "params": {"column": "age", "operator": ">", "value": "35"}}], "rid")
    assert (seen["rows_after"], seen["needs_confirmation"], len(seen["warnings"])) == (1, True, 1)


def test_every_edit_and_step_is_registered():
    assert len(EDITS) == 13 and len(STEPS) == 22


def test_hostile_names(spark):
    name = "a `b` \"c\" d.e"
    df = spark.createDataFrame([(1, 5.0), (2, None)], ["rid", name])
    assert analysis_filter(df, name, "is_null").count() == 1
    assert histogram(df, name).count() == 10
    assert p.column_profile(df).where(F.col("column") == name).first()["null_count"] == 1
    assert m.fill_nulls(df, name, method="mean").where(F.col("`a ``b`` \"c\" d.e`").isNull()).isEmpty()


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "CAST(id AS DOUBLE) AS x").write.parquet(str(tmp_path / "t"))
    kept = analysis_filter(spark.read.parquet(str(tmp_path / "t")), "x", ">", 500).select("x")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,500.0)" in plan and "ReadSchema: struct<x:double>" in plan


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan"))], "rid long, x double")
    assert [r["rid"] for r in analysis_filter(df, "x", ">", 1).collect()] == [1]
    assert top_n(df, "rid", "x").count() == 1


def test_join_matches_missing_keys(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "key string, v int")
    b = spark.createDataFrame([(None, 3), ("z", 4)], "key string, v int")
    assert sorted(map(str, join_tables([a, b], "key", "outer").collect())) == [
        "Row(key='k', v=2, v_dup=None)", "Row(key='z', v=None, v_dup=4)", "Row(key=None, v=1, v_dup=3)"]


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("right", [20, 1])
def test_join_deals_hot_keys(spark, monkeypatch, how, right):
    """Missing and repeated keys in blocks of a few rows, equal rows and a clashing name: the rows of the plain join, dealt."""
    from tallywork.operators import combine

    rows = [(None, 1.0, "same")] * 30 + [("k", float(i), "x") for i in range(90)] + [("lone", 0.5, "x"), ("l2", 0.5, None)]
    a = spark.createDataFrame(rows, "key string, v double, `l0` string").repartition(3)
    b = spark.createDataFrame(
        [(k, i, "b") for k in (None, "k", "only") for i in range(right)] + [("l2", 7, "b")], "key string, v int, z string")
    kinds = a.join(b, a["key"].eqNullSafe(b["key"]), how).count()
    monkeypatch.setattr(combine, "HOT_ROWS", 4)
    monkeypatch.setattr(combine, "BLOCK_ROWS", 8)
    got = combine.join_tables([a, b], "key", how)
    plain = combine._plain_join(a, b, ["key"], how)
    assert got.count() == kinds and got.columns == plain.columns and got.dtypes == plain.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    sizes = got.groupBy("key", F.spark_partition_id().alias("p")).count().where("key = 'k'").agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 1 and sizes[1] < 90 * right


def test_join_of_a_hot_key_is_written_small(spark, tmp_path):
    """All pairs of 3,003 and 1,101 different rows, in an order that files encode: before, some 0.8 bytes a row."""
    a = spark.range(3003).selectExpr("CAST(NULL AS STRING) AS k", "id * 7919 % 3003 AS x")
    b = spark.range(1101).selectExpr("CAST(NULL AS STRING) AS k", "id * 7907 % 1101 AS y", "CAST(sqrt(id) AS STRING) AS z")
    path = tmp_path / "joined"
    join_tables([a.repartition(3, "x"), b], "k", "outer").write.parquet(str(path))
    got = spark.read.parquet(str(path))
    n, x, y, pairs, keys = got.agg(
        F.count("*"), F.sum("x"), F.sum("y"), F.countDistinct(F.col("x") * 1101 + F.col("y")), F.count("k")).first()
    assert (n, pairs, keys) == (3003 * 1101, 3003 * 1101, 0)
    assert (x, y) == (3002 * 3003 // 2 * 1101, 1100 * 1101 // 2 * 3003)
    assert got.select("y", "z").distinct().count() == 1101
    assert sum(f.stat().st_size for f in path.glob("*.parquet")) < n * 0.4


def test_join_deals_chunks_over_blocks(spark, monkeypatch):
    """More copies of a chunk than are made in one step, and keys that alternate: every pair once."""
    from tallywork.operators import combine

    monkeypatch.setattr(combine, "HOT_ROWS", 4)
    monkeypatch.setattr(combine, "BLOCK_ROWS", 8)
    monkeypatch.setattr(combine, "CHUNK_ROWS", 3)
    monkeypatch.setattr(combine, "MOST_TASKS", 8)
    a = spark.range(9, numPartitions=2).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "id AS x")
    b = spark.range(9000, numPartitions=3).selectExpr("IF(id % 3 = 0, NULL, id % 3) AS k", "id AS y")
    got = combine.join_tables([a, b], "k").groupBy("k").agg(
        F.count("*").alias("n"), F.countDistinct("x", "y").alias("pairs"), F.countDistinct("y").alias("ys"))
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {k: (9000, 9000, 3000) for k in (None, 1, 2)}


def test_resample_fills_empty_periods(spark):
    df = spark.sql("SELECT CAST(d AS TIMESTAMP_NTZ) AS d, v FROM VALUES ('2024-01-30', 1.0D), ('2024-04-02', 2.0D) AS t(d, v)")
    rows = resample(df, "d", "v", "ME", "sum").orderBy("d").collect()
    assert [(str(r["d"]), r["v_sum"]) for r in rows] == [
        ("2024-01-31", 1.0), ("2024-02-29", 0.0), ("2024-03-31", 0.0), ("2024-04-30", 2.0)]
    weeks = resample(df, "d", "v", "W", "mean").orderBy("d").collect()
    assert str(weeks[0]["d"]) == "2024-02-04" and weeks[1]["v_mean"] is None


# ------------------------------------------------------------------------ verification


def test_verify_reports_broken_steps(spark):
    df = column(spark, ["$5", "Free", "n/a", "one", "x1"])
    steps = [{"operation": s, "column": "c"} for s in (
        "remove_currency_symbols", "free_to_zero", "remove_vague_entries", "convert_number_words", "extract_number")]
    got = {r["operation"]: (r["passed"], r["n_bad"]) for r in v.postconditions(df, steps, "rid").collect()}
    assert got == {"remove_currency_symbols": (False, 1), "free_to_zero": (False, 1), "remove_vague_entries": (False, 1),
                   "convert_number_words": (False, 1), "extract_number": (False, 5)}


def test_quality_flags_off_for_generic_tables(spark):
    df = spark.createDataFrame([(i, "$5") for i in range(5)], "rid long, price string")
    assert q.quality_flags(df, "rid").count() == 0
    assert q.quality_flags(df, "rid", domain="survey").first()["flag"] == "currency"


# ----------------------------------------------------------------------- files, streams


def test_content_check(spark, tmp_path):
    for name, data in {"a.parquet": b"PAR1xx", "b.parquet": b"nope", "c.json": b"[1]", "d.json": b"x", "e.csv": b"q", "f.csv": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"][-9:].lstrip("/"): r["valid"] for r in readers.content_check(spark, str(tmp_path)).collect()}
    assert {k.split("/")[-1]: x for k, x in got.items()} == {
        "a.parquet": True, "b.parquet": False, "c.json": True, "d.json": False, "e.csv": True, "f.csv": False}


def test_json_array_and_csv_quotes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1, "y": "p"}, {"x": 2, "y": null}]')
    assert readers.read_table(spark, str(tmp_path / "a.json")).count() == 2
    df = spark.createDataFrame([(1, '=1+1, "quoted"\nsecond line')], "x int, t string")
    writers.write_csv(df, str(tmp_path / "out.csv"))
    assert readers.read_csv(spark, str(tmp_path / "out.csv")).first()["t"] == '\'=1+1, "quoted"\nsecond line'


def test_stream_equals_batch_and_refuses_statistics(spark):
    steps = [{"operation": s, "column": "c"} for s in CELLS]
    df = column(spark, ["$5", "Free", "n/a", "one hundred", " 2 hours "])
    assert values(clean_stream(df, steps)) == values(run_cleaning(df, steps, "rid").df)
    with pytest.raises(Refusal, match="whole table"):
        clean_stream(df, [{"operation": "deduplicate"}])
