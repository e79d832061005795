"""The pipeline: stages on small documents, their decisions, and the registered queries."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__ as entry
from test_operators import sets_of

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR).cache()
        if name != "sharding":
            assert out.columns == corpus_pipeline.COLUMNS
        if name in ("toxicity", "near_copies", "decontamination"):
            ids = [r["doc_id"] for r in out.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) and 0.6 * before < len(ids) <= before
            before = len(ids)
        if name == "sharding":
            slots = collections.defaultdict(list)
            for r in out.collect():
                slots[r["shard"]].append(r["slot"])
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
            assert out.count() == docs.count()
        docs = out


def test_near_copies_against_all_pairs(spark):
    own = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(80)
    words = [f"w{i}" for i in range(60)]
    planted = [(90_000 + i, " ".join(words[:30] + [f"x{i}"] * (i % 4) + words[30:]), "en", "s", 1) for i in range(8)]
    planted += [(90_100, "only three words", "en", "s", 1), (90_101, "only three words", "en", "s", 1), (90_102, "", "en", "s", 1)]
    rows = [tuple(r) for r in own.collect()] + planted
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, own.schema), SF_DIR)
    sets = sets_of([(r[0], r[1]) for r in rows], 5)
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a & b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted(i for i, _ in sets if find(i) == i)
    assert len(want) < len(rows) and sorted(r["doc_id"] for r in out.collect()) == want


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
