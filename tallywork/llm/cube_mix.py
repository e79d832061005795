"""Mixing sources to target weights by cube sampling.

Every source gets a target number of words from its weight (``targets``). A document then has the inclusion
number target / size of its source: the whole part says how many copies are certain, the fraction is the
probability of one more. The fractions move through the null space of the constraints "number of documents"
and "number of words" (per source), three documents at a time, until all but two of a chunk have arrived
at 0 or 1; both totals stay as they are at every step. What is left of the chunks meets in further rounds,
until each source has at most two undecided documents. That small landing problem is solved by the choice
that comes nearest to the source's words.

Chunks hold about ``chunk`` documents, so a source with a third of all rows is spread over many tasks.
Random choices come from hashes of id and size, and chunks are sorted: the result does not depend on how
the input is partitioned.

Defined results: null texts have size 0 and are decided like others, but take no words; the null source
is a source of its own, ordered last; a source without words has target 0; rows equal in id, size and
source are exchangeable and share a chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import take
from tallywork.operators.ordering import stamp_rid
from tallywork.session import cut_lineage

WEIGHTS = (5, 2, 1)
NEAR = 1e-9


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size -> with the target of each source.

    Sources in code point order (null last) take ``weights`` in turn and share all words by them. A target
    stops at ``most`` times its source's size; the excess goes to the others by weight, until none is above.
    """
    numbered = stamp_rid(sizes.orderBy(F.col("source").asc_nulls_last()), "_rank", from_files=False)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = cut_lineage(numbered.withColumn("weight", weight))
    cap = most * F.col("source_size")
    total, weighed = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) / weighed if weighed else 0.0, -1
    while True:  # each round caps at least one more source
        above = cap <= level * F.col("weight")
        now = rows.agg(
            F.count(F.when(above, 1)).alias("n"), F.sum(F.when(above, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if now["n"] == capped or not now["open"]:
            break
        capped, level = now["n"], (total - now["held"]) / now["open"]
    share = F.least(cap, F.lit(level) * F.col("weight")) if weighed else F.lit(0.0)
    return rows.select("source", "source_size", share.alias("target"))


def flight(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Move the fractions ``p`` until at most two lie inside (0, 1); sums of p and of p * size stay."""
    p = p.copy()
    held: list[int] = []
    for i in range(len(p)):
        if NEAR < p[i] < 1 - NEAR:
            held.append(i)
        while len(held) >= 2:
            a, b = held[0], held[1]
            if size[a] == size[b]:
                ids, u = (a, b), (1.0, -1.0)
            elif len(held) == 3:
                c = held[2]
                ids, u = (a, b, c), (size[c] - size[b], size[a] - size[c], size[b] - size[a])
                scale = max(map(abs, u))
                u = tuple(x / scale for x in u)
            else:
                break
            forth = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(ids, u) if x)
            back = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(ids, u) if x)
            step = forth if chance[i] * (forth + back) < back else -back
            for k, x in zip(ids, u):
                p[k] = min(1.0, max(0.0, p[k] + step * x))
            for k in ids:
                if p[k] <= NEAR or p[k] >= 1 - NEAR:
                    p[k] = round(p[k])
                    held.remove(k)
    return p


def land(size: np.ndarray, p: np.ndarray, flips: int = 4) -> np.ndarray:
    """Decide the last fractions (two at most) so that the words come nearest to what was to be taken.

    Single decisions that bring the words still nearer are turned over, ``flips`` at most.
    """
    p = p.copy()
    wanted = float((p * size).sum())
    rest = np.flatnonzero((p > NEAR) & (p < 1 - NEAR))
    choices = [[(c >> k) & 1 for k in range(len(rest))] for c in range(1 << len(rest))]
    fixed = wanted - float((p[rest] * size[rest]).sum())
    p[rest] = min(choices, key=lambda c: (abs(float(np.dot(c, size[rest])) + fixed - wanted), c))
    p = np.round(p)
    for _ in range(flips):
        off = float((p * size).sum()) - wanted
        turned = np.abs(off + np.where(p > 0, -size, size))
        best = int(np.argmin(turned)) if len(p) else 0
        if not len(p) or turned[best] >= abs(off) - 0.5:
            break
        p[best] = 1 - p[best]
    return p


def _round(last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "chance", "doc_id"], ascending=[False, True, True], ignore_index=True)
        size = group["size"].to_numpy(float)
        p = flight(size, group["part"].to_numpy(float), group["chance"].to_numpy(float))
        return group.assign(part=land(size, p) if last else p)

    return run


def cube_sample(units: DataFrame, chunk: int = 4_000) -> DataFrame:
    """``units`` (doc_id string, source, size, part, chance, ...): ``part`` decided to 0 or 1.

    Each round leaves at most two undecided rows of a chunk, so few rounds suffice; the last has one chunk
    per source and lands.
    """
    decided = []
    while True:
        open_rows = units.where((F.col("part") > NEAR) & (F.col("part") < 1 - NEAR))
        decided.append(units.where((F.col("part") <= NEAR) | (F.col("part") >= 1 - NEAR)))
        counts = open_rows.groupBy("source").agg(F.count("*").alias("_n"))
        counts = cut_lineage(counts.select(F.col("source").alias("_of"), F.ceil(F.col("_n") / chunk).alias("_chunks")))
        most = counts.agg(F.max("_chunks")).first()[0]
        if most is None:
            break
        dealt = open_rows.join(counts, F.col("source").eqNullSafe(F.col("_of")))
        number = F.pmod(F.xxhash64("doc_id", "size", F.lit(len(decided))), F.col("_chunks"))
        dealt = dealt.select(*units.columns, number.alias("_chunk"))
        run = _round(most == 1)
        moved = dealt.groupBy("source", "_chunk").applyInPandas(
            lambda g: run(g.drop(columns="_chunk")), units.schema)
        units = cut_lineage(moved)
        if most == 1:
            decided.append(units)
            break
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out


def words(text: str) -> Column:
    """Column: number of words (runs of anything but ASCII white space)."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights=WEIGHTS, most: float = 3.0, chunk: int = 4_000,
) -> DataFrame:
    """doc_id, size, source, source_size, target, copies and taken (size times copies) of every row."""
    rows = take(df, doc_id=doc_id, text=text, source=source)
    rows = cut_lineage(rows.select("doc_id", "source", words("text").alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = targets(sizes, weights, most).withColumnRenamed("source", "_of")
    joined = rows.join(aims, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    number = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(number + NEAR)
    chance = (F.pmod(F.xxhash64(F.lit(7), "doc_id", "size"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    kind = dict(df.dtypes)[doc_id]
    units = joined.select(
        F.col("doc_id").cast("string").alias("doc_id"), "source", "size", "source_size", "target",
        whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), number - whole).alias("part"), chance.alias("chance"))
    copies = F.col("whole") + F.round("part").cast("long")
    return cube_sample(cut_lineage(units), chunk).select(
        F.col("doc_id").cast(kind).alias("doc_id"), "size", "source", "source_size", "target",
        copies.alias("copies"), (F.col("size") * copies).alias("taken"))
