"""Distributed order blocks against brute force, with one value holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.operators import ordering as o


def skewed(n=3000, seed=7):
    rng = random.Random(seed)
    return [(i, 42.0 if i % 3 == 0 else round(rng.gauss(40, 20), 1), "ab"[i % 2]) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(skewed(), "rid long, x double, g string").repartition(7)


PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]


@pytest.mark.parametrize("rows", [50_000, 50])
def test_exact_quantiles(frame, monkeypatch, rows):
    monkeypatch.setattr(o, "BRACKET_ROWS", rows)
    got = o.exact_quantiles(frame, {"x": F.col("x"), "r": F.col("rid")}, PROBS)
    data = skewed()
    np.testing.assert_allclose(got["x"], np.quantile([r[1] for r in data], PROBS))
    np.testing.assert_allclose(got["r"], np.quantile([r[0] for r in data], PROBS))


@pytest.mark.parametrize("sketch", [10_000, 200])
def test_grouped_quantiles(frame, monkeypatch, sketch):
    monkeypatch.setattr(o, "SKETCH", sketch)
    names = {f"q{i}": p for i, p in enumerate(PROBS)}
    got = {r["g"]: r for r in o.grouped_quantiles(frame, "x", names, ["g"]).collect()}
    for g in "ab":
        want = np.quantile([r[1] for r in skewed() if r[2] == g], PROBS)
        np.testing.assert_allclose([got[g][n] for n in names], want)


def test_grouped_quantiles_with_a_hot_group(spark, monkeypatch):
    """Brackets are narrowed until each holds few rows or one value, and the answer stays exact."""
    monkeypatch.setattr(o, "SKETCH", 400)
    monkeypatch.setattr(o, "BRACKET_ROWS", 25)
    rng = random.Random(3)
    rows = [("hot", rng.gauss(0, 1)) for _ in range(6000)] + [("ties", float(rng.randrange(3))) for _ in range(4000)]
    rows += [("two", float(i % 2)) for i in range(1000)] + [("small", rng.random()) for _ in range(9)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    names = {f"q{i}": p for i, p in enumerate(PROBS)}
    got = {r["g"]: r for r in o.grouped_quantiles(df, "x", names, ["g"]).collect()}
    for g in ("hot", "ties", "two", "small"):
        np.testing.assert_allclose([got[g][n] for n in names], np.quantile([x for h, x in rows if h == g], PROBS))
    v = df.select("g", F.col("x").alias("_v"))
    for r in o.group_brackets(v, PROBS, ["g"]).collect():
        own = np.array([x for h, x in rows if h == r["g"]])
        for i in range(len(PROBS)):
            inside = own[(own >= r[f"_lo{i}"]) & (own <= r[f"_hi{i}"])]
            assert len(inside) <= 25 or len(set(inside)) <= 3


def test_no_group_is_sorted_as_a_whole(spark):
    df = spark.createDataFrame([("abc"[i % 3], float(i % 101)) for i in range(3000)], "g string, x double")
    plan = o.grouped_quantiles(df, "x", {"m": 0.5}, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_i#" in line.split("[")[2] for line in windows)


def test_grouped_quantiles_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["m"] for r in o.grouped_quantiles(df, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 1.0, "b": 1.5}


def test_average_ranks(frame):
    got = {r["x"]: r["rank"] for r in o.average_ranks(frame, "x").collect()}
    values = np.array([r[1] for r in skewed()])
    order = np.sort(values)
    for v in set(values):
        lo, hi = np.searchsorted(order, v, "left"), np.searchsorted(order, v, "right")
        assert got[v] == pytest.approx((lo + 1 + hi) / 2)


def test_average_ranks_per_segment(frame):
    got = {(r["g"], r["x"]): r["rank"] for r in o.average_ranks(frame, "x", ["g"]).collect()}
    for g in "ab":
        order = np.sort([r[1] for r in skewed() if r[2] == g])
        v = order[100]
        want = (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2
        assert got[(g, v)] == pytest.approx(want)


def test_range_bounds_give_a_hot_value_its_own_range(frame):
    bounds = o.range_bounds(frame, "x", 12)
    cut = o.with_range(frame, "x", bounds)
    mixed = cut.groupBy("_b").agg(F.count_distinct("x").alias("k"), F.max((F.col("x") == 42.0).cast("int")).alias("hot"))
    assert [r["k"] for r in mixed.where("hot = 1").collect()] == [1]


def test_carry_and_previous_row(spark):
    data = [(i, None if i % 5 else float(i)) for i in range(3, 500)]
    df = spark.createDataFrame(data, "rid long, v double").repartition(5)
    forward = {r["rid"]: r["v"] for r in o.carry(df, "rid", "v").collect()}
    backward = {r["rid"]: r["v"] for r in o.carry(df, "rid", "v", forward=False).collect()}
    for i, _ in data:
        assert forward[i] == (None if i < 5 else i - i % 5)
        assert backward[i] == (None if i > 495 else i + (-i) % 5)
    before = {r["rid"]: r["p"] for r in o.previous_row(df, "rid", {"rid": "p"}).collect()}
    assert all(before[i] == (None if i == 3 else i - 1) for i, _ in data)


def test_dense_ordinal_and_stamp(spark, tmp_path):
    df = spark.range(0, 1000, 1, 9).select((F.col("id") * 7 + 3).alias("k"))
    assert o.dense_ordinal(df, "k").where("_ord * 7 + 3 <> k").isEmpty()
    df.write.parquet(str(tmp_path / "t"))
    stamped = o.stamp_rid(spark.read.parquet(str(tmp_path / "t")))
    row = stamped.agg(F.min("_rid"), F.max("_rid"), F.count_distinct("_rid")).first()
    assert tuple(row) == (0, 999, 1000)


def test_stamp_of_a_shuffled_frame_is_stable(spark):
    df = spark.range(500).repartition(6).withColumn("x", F.rand())
    stamped = o.stamp_rid(df, from_files=False)
    assert stamped.collect() == stamped.collect()
    assert stamped.agg(F.count_distinct("_rid")).first()[0] == 500


def test_row_number_limits_run_before_the_shuffle(spark):
    from tallywork.operators.profiling import heads

    df = spark.range(1000).selectExpr("id AS rid", "CAST(id AS STRING) AS a", "CAST(id % 7 AS STRING) AS b")
    plan = heads(df, "rid", ["a", "b"], 50)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_no_row_of_data_meets_an_unpartitioned_window(spark):
    df = spark.createDataFrame([(i, float(i % 11)) for i in range(300)], "rid long, x double")
    plan = o.average_ranks(df, "x")._jdf.queryExecution().executedPlan().toString()
    single = plan.split("Exchange SinglePartition")
    assert len(single) == 2 and "HashAggregate(keys=[_b" in single[1][:400]  # the one-row-per-range table


def test_carry_backward_frames_grow(spark):
    """Repeated and missing order keys; no frame that Spark reads anew for every row."""
    rows = [(i // 2, i, "v" if i % 5 == 4 else None) for i in range(40)] + [(99, 99, None)]
    df = spark.createDataFrame(rows, "rid long, n long, v string")
    out = o.carry(df, "rid", "v", forward=False)
    assert "unboundedfollowing" not in out._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["n"]: r["v"] for r in out.collect()}
    assert got[99] is None and all(got[n] == "v" for n in range(40)) and len(got) == 41
    nulls = spark.createDataFrame([(None, "x"), (1, None), (2, "y"), (3, None)], "rid long, v string")
    got = {r["rid"]: r["v"] for r in o.carry(nulls, "rid", "v", forward=False).collect()}
    assert got == {None: "x", 1: "y", 2: "y", 3: None}


def test_rows_meet_few_groups_where_they_are(spark, monkeypatch):
    """A hot group's rows are not sorted by one task to meet the group's median."""
    from tallywork.operators import means

    rows = spark.range(3000).selectExpr("CAST(id % 3 AS STRING) AS g", "CAST(id * id % 101 AS DOUBLE) AS x")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        spread = means.brown_forsythe_moments(rows, [])
        assert "SortMergeJoin" not in plan(spread)
        few = {tuple(r) for r in spread.collect()}
        monkeypatch.setattr(o, "FEW_GROUPS", 2)
        many = means.brown_forsythe_moments(rows, [])
        assert "SortMergeJoin" in plan(many) and len(few) == 3
        assert [r[:2] for r in sorted(few)] == [r[:2] for r in sorted(map(tuple, many.collect()))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


@pytest.mark.parametrize("rows", [50_000, 50])
def test_quantiles_read_off_one_cell_a_column(frame, monkeypatch, rows):
    """Many close quantiles of a column: overlapping brackets are one stretch, and each cell is looked at once."""
    monkeypatch.setattr(o, "BRACKET_ROWS", rows)
    made, struct, probs = [], F.struct, [0.2, 0.21, 0.215, 0.3, 0.5, 0.501, 0.9]
    monkeypatch.setattr(F, "struct", lambda *c: made.append(c) or struct(*c))
    got = o.exact_quantiles(frame, {"x": F.col("x"), "r": F.col("rid")}, probs)
    assert len(made) == 2
    np.testing.assert_allclose(got["x"], np.quantile([r[1] for r in skewed()], probs))
    np.testing.assert_allclose(got["r"], np.quantile([r[0] for r in skewed()], probs))
