"""Fits per segment against the fit of the segment's rows alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.errors import Refusal
from tallywork.operators import regression as r
from tallywork.operators import segments as s


@pytest.fixture(scope="module")
def rows(spark):
    """Three segments, one of them null; level z occurs in one only, 'thin' has too few rows."""
    rng = np.random.default_rng(8)
    out = []
    for seg, size, levels, shift in (("a", 90, "pqz", 0.0), ("b", 60, "qr", 5000.0), (None, 70, "pr", -3.0)):
        for i in range(size):
            x, g = shift + rng.normal(), levels[int(rng.integers(len(levels)))]
            lin = 0.4 * (x - shift) + 0.5 * (g == "q")
            out.append((seg, x, g, float(2 + lin + rng.normal()), "yes" if rng.random() < 1 / (1 + np.exp(-lin)) else "no",
                        float(rng.poisson(np.exp(0.5 + lin) * rng.gamma(2.0, 0.5))), 1.0 + float(rng.random())))
    out += [("thin", 1.0, "p", 1.0, "yes", 1.0, 1.0), ("thin", 2.0, "q", 3.0, "no", 2.0, 1.0)]
    out += [("flat", 7.0, "pq"[i % 2], float(i), "yes", 0.0, 1.0) for i in range(12)]
    out += [("a", None, "p", 1.0, "yes", 1.0, 1.0), ("b", 5000.0, None, 2.0, "no", 1.0, 1.0)]
    return spark.createDataFrame(
        out, "seg string, x double, g string, y double, hit string, k double, w double").repartition(5).cache()


def same(found, alone, seg):
    """Coefficients and summary of one segment equal those of its rows alone."""
    own = F.col("seg").eqNullSafe(F.lit(seg))
    got = {c["term"]: c.asDict() for c in found.coefficients.where(own).collect()}
    want = {c["term"]: c.asDict() for c in alone.coefficients.collect()}
    assert set(got) == set(want)
    for term in want:
        for c, v in want[term].items():
            assert c == "term" or got[term][c] == pytest.approx(v, rel=2e-5, abs=1e-7), (seg, term, c)
    g, w = found.summary.where(own).first().asDict(), alone.summary.first().asDict()
    assert g["reason"] is None
    for c, v in w.items():
        assert g[c] == pytest.approx(v, rel=2e-6, abs=1e-9), (seg, c)


def alone(rows, seg):
    return rows.where(F.col("seg").eqNullSafe(F.lit(seg)))


@pytest.mark.parametrize("robust", ["none", "HC3"])
def test_ols(rows, robust):
    found = s.ols_by(rows, "y", ["x", "g"], ["seg"], robust)
    for seg in ("a", "b", None):
        same(found, r.ols(alone(rows, seg), "y", ["x", "g"], robust), seg)
    reasons = {x["seg"]: x["reason"] for x in found.summary.collect()}
    assert "usable" in reasons["thin"] and "constant" in reasons["flat"]
    assert found.coefficients.where("seg IN ('thin', 'flat')").count() == 0
    assert found.summary.where("seg = 'thin'").first()["r_squared"] is None


def test_refused(rows):
    with pytest.raises(Refusal, match="segment"):
        s.ols_by(rows, "y", ["x"], [])
    with pytest.raises(Refusal, match="segment and a regressor"):
        s.ols_by(rows, "y", ["seg"], ["seg"])


def test_empty(rows):
    found = s.ols_by(rows.where("false"), "y", ["x"], ["seg"])
    assert found.coefficients.count() == 0 and found.summary.count() == 0


def test_logit(rows):
    found = s.logit_by(rows, "hit", ["x", "g"], "yes", ["seg"], "HC0")
    for seg in ("a", None):
        same(found, r.logit(alone(rows, seg), "hit", ["x", "g"], "yes", "HC0"), seg)
    assert "usable" in found.summary.where("seg = 'thin'").first()["reason"]


def test_logit_odd_segments(spark):
    """A separated segment, one with a single outcome and one with three are left out."""
    data = [("sep", float(i), "yes" if i >= 20 else "no") for i in range(40)]
    data += [("one", float(i), "no") for i in range(10)]
    data += [("three", float(i), ("yes", "no", "maybe")[i % 3]) for i in range(30)]
    data += [("fine", float(i % 7), ("yes", "no")[(i * i) % 5 % 2]) for i in range(50)]
    df = spark.createDataFrame(data, "seg string, x double, hit string")
    found = s.logit_by(df, "hit", ["x"], "yes", ["seg"])
    reason = {x["seg"]: x["reason"] for x in found.summary.collect()}
    assert "separated" in reason["sep"] or "converge" in reason["sep"]
    assert "never or always" in reason["one"] and "two values" in reason["three"] and reason["fine"] is None
    assert {x["seg"] for x in found.coefficients.select("seg").collect()} == {"fine"}


@pytest.mark.parametrize("family, exposure", [("poisson", "w"), ("negative_binomial", None)])
def test_counts(rows, family, exposure):
    found = s.count_model_by(rows, "k", ["x", "g"], ["seg"], family, exposure)
    for seg in ("a", "b"):
        same(found, r.count_model(alone(rows, seg), "k", ["x", "g"], family, exposure), seg)
    reason = {x["seg"]: x["reason"] for x in found.summary.collect()}
    assert "constant" in reason["flat"] and "usable" in reason["thin"]


def test_task_functions_after_column_functions(spark, tmp_path):
    """Distribution columns used before leave nothing in the functions that travel to tasks, which need no package there."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    from tallywork.functions import dist

    spark.range(3).select(dist.norm_sf(F.lit(1.0)), dist.t_sf2(F.lit(1.0), F.lit(4.0))).collect()
    sent = tmp_path / "task"
    sent.write_bytes(cloudpickle.dumps(lambda: (dist.t_point(0.975, 4), dist.rank_sum_p(1.0, 2.0, 2.0), r._coefficients)))
    code = f"import pickle; print(round(pickle.load(open({str(sent)!r}, 'rb'))()[0], 4))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": ""}, capture_output=True, text=True)
    assert done.stdout.strip() == "2.7764", done.stderr
    data = [(s, float(i), float(i * i % 7)) for s in "ab" for i in range(12)]
    df = spark.createDataFrame(data, "seg string, x double, y double")
    assert s.ols_by(df, "y", ["x"], ["seg"]).summary.where("reason IS NULL").count() == 2
