"""Near copies by MinHash bands, with odd sketches between the bands and the exact check.

Every text becomes the set of its word shingles (64-bit hashes); equal sets are one class. Of each class:

1. MinHash samples: the least of the set's tokens under each of ``SAMPLES`` hash functions. Some samples
   together are a band; classes with an equal band share a bucket. Samples per band are as many as leave a pair
   at the threshold a chance below ``MISSED`` of sharing no bucket (6 of 252 samples at 85 %: 2 in 10^9).
2. Odd sketch: all samples are folded into a bitmap of ``BITS`` cells, each sample flipping one. Equal samples
   cancel in the XOR of two bitmaps, so its population count tells how many samples differ, and by that the
   similarity, closely where it is high. A candidate goes on if the estimate is within ``MARGIN`` of the
   threshold or above (six standard deviations).
3. Stars: in each bucket every class is a candidate with the bucket's pivot only, its most copied class. A family
   of any size becomes one component by that, without its pairs.
4. The rest: classes of a bucket that are still in different components are compared with each other, in blocks
   of bounded rows and tokens. A component that fills blocks of its own meets the other blocks, not itself, so
   the work is (outsiders x members), and what is written is the members per block, never pairs. Buckets with
   equal members are worked on once. Only classes with a candidate have their text fetched.

Links are confirmed on full sets: 100 * shared >= percent * union. Inside a block, classes that have become one
component are not tested again. Components of all links give each document the smallest doc_id it reaches.

Work of the last step is quadratic in the classes of one bucket that are *not* near copies of each other but
still share a band; it is done on bitmaps, block by block, on as many tasks as there are pairs of blocks.

Defined results: null and empty texts and texts without words have no shingles and are linked with nothing
(component: their own id); texts with fewer words than a shingle are one shingle as a whole; repeated rows and
ties in size share their class; a null doc_id never names a component, so a class of null ids only has a null
one; very long texts are hashed whole and fill a block alone; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import mixed, only_cells, release, slices, take, trim, written
from tallywork.llm.components import components
from tallywork.llm.jaccard_join import class_id, shingle_sets
from tallywork.session import cut_lineage

SAMPLES, BITS, MARGIN, MISSED = 252, 512, 0.2, 1e-8
# Classes and tokens that a block holds on each side.
BLOCK, TOKENS = 1024, 1 << 20
SEEDS = mixed(np.arange(1, 3 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(3, SAMPLES)


def band_rows(percent: int) -> int:
    """The most samples per band with which a pair at the threshold is hardly ever missed."""
    missed = lambda r: (1 - (percent / 100) ** r) ** (SAMPLES // r)
    return max(r for r in range(1, 16) if r == 1 or missed(r) <= MISSED)


def most_flips(percent: int) -> int:
    """Cells in which the odd sketches of two classes may differ whose estimate is no more than MARGIN too low."""
    apart = SAMPLES * (1 - percent / 100 + MARGIN)
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * apart / BITS)))


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per set (none is empty)."""
    tokens = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), SAMPLES), np.uint64)
    for i in range(SAMPLES):
        out[:, i] = np.minimum.reduceat((tokens ^ SEEDS[0, i]) * (SEEDS[1, i] | np.uint64(1)), starts)
    return out


def bands(least: np.ndarray, rows: int) -> np.ndarray:
    """One number per band, different between bands."""
    n = SAMPLES // rows
    each = mixed(least[:, : n * rows] ^ SEEDS[2, : n * rows]).reshape(len(least), n, rows)
    return mixed((each * SEEDS[1, :rows]).sum(axis=2, dtype=np.uint64) + np.arange(n, dtype=np.uint64)).view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Per row of samples BITS cells, packed: whether an odd number of samples falls into each."""
    cell = (mixed(least ^ SEEDS[2]) % np.uint64(BITS)).astype(np.int64) + BITS * np.arange(len(least))[:, None]
    odd = np.bincount(cell.reshape(-1), minlength=BITS * len(least)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1)


def _digest(k: int, percent: int):
    rows = band_rows(percent)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            odd, keys = [None] * len(sets), [None] * len(sets)
            if full:
                least = samples([sets[i] for i in full])
                for i, o, b in zip(full, odd_sketch(least).view(np.int64), bands(least, rows)):
                    odd[i], keys[i] = o, b
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                pa.array(odd, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "row", "n", "cid", "odd", "bands"])
        trim()

    return run


def flips(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS // 64)), F.lit(0))


def near_in_size(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def star_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cid, pivot: classes and pivots of their buckets that the odd sketches leave as candidates."""
    pairs = members.where("cid <> pivot").select("cid", "pivot").distinct()
    of = classes.select("cid", "n", "odd")
    told = pairs.join(of, "cid").join(of.select(F.col("cid").alias("pivot"), F.col("n").alias("_n"), F.col("odd").alias("_odd")), "pivot")
    near = told.where(near_in_size("n", "_n", percent) & (flips("odd", "_odd") <= most_flips(percent)))
    return cut_lineage(near.select("cid", "pivot"))


def with_texts(docs: DataFrame, classes: DataFrame, work: DataFrame) -> DataFrame:
    """``work`` (with cid) and the text of each class."""
    wanted = work.join(classes.select("cid", F.xxhash64("rep.doc_id", "rep.row").alias("_key")), "cid")
    wanted = cut_lineage(wanted)
    found = only_cells(docs.select("text", F.xxhash64("doc_id", "row").alias("_key")), "_key", wanted)
    return found.join(wanted, "_key").drop("_key")


def shared_with(own: np.ndarray, tokens: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
    """How many tokens the set ``own`` shares with each of the sets ``which``, which lie end to end in ``tokens``."""
    sizes = ends[which + 1] - ends[which]
    at = np.repeat(ends[which] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    hit = own[np.minimum(np.searchsorted(own, tokens[at]), len(own) - 1)] == tokens[at]
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)


def links_among(sets: list[np.ndarray], labels: np.ndarray, tries, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join different labels; ``tries`` yields i and the members to try with it."""
    n = np.array([len(s) for s in sets], np.int64)
    tokens, ends, out = np.concatenate(sets), np.concatenate(([0], np.cumsum(n))), []
    for i, others in tries:
        others = others[(labels[others] != labels[i]) & (100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others]))]
        if not len(others):
            continue
        both = shared_with(sets[i], tokens, ends, others)
        for j in others[100 * both >= percent * (n[i] + n[others] - both)].tolist():
            if labels[i] != labels[j]:
                out.append((i, j))
                labels[labels == labels[j]] = labels[i]
    return out


def _star_block(k: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cid").sort_values(["is_pivot", "cid"], ignore_index=True)
        if not group["is_pivot"].iloc[-1] or len(group) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets, ids, last = shingle_sets(list(group["text"]), k), group["cid"].tolist(), len(group) - 1
        found = links_among(sets, np.arange(len(sets)), [(last, np.arange(last))], percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return run


def star_links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    crowd = pairs.groupBy(F.col("pivot").alias("_pivot")).agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    name = lambda chunk: F.xxhash64("_pivot", chunk).alias("block")
    members = pairs.join(crowd, F.col("pivot") == F.col("_pivot")).select(
        name(F.pmod(F.xxhash64("cid"), F.col("chunks"))), "cid", F.lit(False).alias("is_pivot"))
    pivots = crowd.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        name(F.col("chunk")), F.col("_pivot").alias("cid"), F.lit(True).alias("is_pivot"))
    found = with_texts(docs, classes, members.unionByName(pivots))
    return cut_lineage(found.groupBy("block").applyInPandas(_star_block(k, percent), "a long, b long"))


def open_blocks(members: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """block, side, cid, root, n, odd: what is left to compare in buckets whose members are in several components.

    side 0 is compared with side 1, or within itself where a block has no side 1.
    """
    rest = members.where("cid <> pivot").join(roots, F.col("cid") == F.col("node"), "left").select(
        "key", "cid", F.coalesce("root", "cid").alias("root"))
    rest = cut_lineage(rest)
    several = rest.groupBy("key").agg(
        F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("cid")).alias("sign"))
    # buckets with the same members, as similar classes have in many bands, are one
    keep = several.where("a <> b").groupBy("c", "sign").agg(F.min("key").alias("_key")).select("_key")
    rows = rest.join(keep, F.col("key") == F.col("_key"), "left_semi").join(classes.select("cid", "n", "odd"), "cid")
    rows = cut_lineage(rows.select("key", "cid", "root", "n", "odd"))
    chunks = F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("t") / TOKENS)).alias("chunks")
    parts = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("t"))
    parts = cut_lineage(parts.withColumn("big", F.when((F.col("c") >= BLOCK) | (F.col("t") >= TOKENS), F.col("root"))))
    sets = parts.groupBy("key", "big").agg(chunks)
    label = lambda chunk: F.xxhash64("key", "big", chunk)
    one = sets.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    one = cut_lineage(one.select("key", "big", label(F.col("chunk")).alias("label")))
    two = one.select(F.col("key").alias("_k"), F.col("big").alias("_big"), F.col("label").alias("_label"))
    small, small2 = one.where("big is null"), two.where("_big is null")
    same = F.col("key") == F.col("_k")
    pairs = small.join(small2, same & (F.col("label") <= F.col("_label")))
    pairs = pairs.unionByName(small.join(two.where("_big is not null"), same))
    pairs = pairs.unionByName(one.where("big is not null").join(two.where("_big is not null"), same & (F.col("big") < F.col("_big"))))
    pairs = cut_lineage(pairs.select("label", "_label"))
    block = F.xxhash64("label", "_label").alias("block")
    sides = pairs.select(block, F.col("label").alias("_of"), F.lit(0).alias("side")).unionByName(
        pairs.where("label <> _label").select(block, F.col("_label").alias("_of"), F.lit(1).alias("side")))
    is_big = parts.where("big is not null").select(F.col("key").alias("_k"), "big")
    placed = rows.join(is_big, (F.col("key") == F.col("_k")) & (F.col("root") == F.col("big")), "left")
    sizes = sets.select(F.col("key").alias("_k2"), F.col("big").alias("_big"), "chunks")
    placed = placed.join(sizes, (F.col("key") == F.col("_k2")) & F.col("big").eqNullSafe(F.col("_big")))
    placed = placed.select("cid", "root", "n", "odd", label(F.pmod(F.xxhash64("cid"), F.col("chunks"))).alias("label"))
    return placed.join(sides, F.col("label") == F.col("_of")).select("block", "side", "cid", "root", "n", "odd")


def candidates(group: pd.DataFrame, percent: int):
    """i and the members that its odd sketch leaves, for each row of a block sorted by side."""
    odd = np.stack(group["odd"].to_numpy()).astype(np.int64).view(np.uint64)
    n, root, side = (group[c].to_numpy(np.int64) for c in ("n", "root", "side"))
    most, first = most_flips(percent), int(np.searchsorted(side, 1))
    for i in range(first):
        others = np.arange(first, len(n)) if first < len(n) else np.arange(i + 1, len(n))
        own = (root[others] != root[i]) & (100 * np.minimum(n[i], n[others]) >= percent * np.maximum(n[i], n[others]))
        others = others[own]
        if len(others):
            yield i, others[np.bitwise_count(odd[others] ^ odd[i]).sum(axis=1) <= most]


def _screen_block(percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cid").sort_values(["side", "cid"], ignore_index=True)
        stays = np.zeros(len(group), bool)
        for i, others in candidates(group, percent):
            stays[i] |= len(others) > 0
            stays[others] = True
        return group.loc[stays, ["block", "side", "cid", "root", "n", "odd"]]

    return run


def _exact_block(k: int, percent: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("cid").sort_values(["side", "cid"], ignore_index=True)
        sets, ids = shingle_sets(list(group["text"]), k), group["cid"].tolist()
        found = links_among(sets, group["root"].to_numpy(np.int64).copy(), candidates(group, percent), percent)
        return pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"], dtype="int64")

    return run


BLOCK_ROWS = "block long, side int, cid long, root long, n long, odd array<long>"


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, component_id and kept (doc_id is its component's) of every row."""
    spark = df.sparkSession
    docs = take(df, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = written(docs.mapInArrow(
        _digest(k, percent), f"doc_id {kind}, row long, n long, cid long, odd array<long>, bands array<long>"), "odd-sketches")
    rows = digests.select("doc_id", "row", "n", "cid")
    classes = written(digests.where("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("rep"),
        F.count("*").alias("copies"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("bands").alias("bands")), "sketch-classes")
    entries = classes.select("cid", "copies", F.explode("bands").alias("key"))
    buckets = entries.groupBy(F.col("key").alias("_key")).agg(
        F.count("*").alias("c"), F.max(F.struct("copies", "cid"))["cid"].alias("pivot")).where("c > 1").drop("c")
    members = cut_lineage(entries.join(buckets, F.col("key") == F.col("_key")).select("key", "cid", "pivot"))
    stars = star_links(docs, classes, star_pairs(members, classes, percent), k, percent)
    release(spark)
    roots = cut_lineage(components(stars))
    blocks = open_blocks(members, classes, roots)
    work = cut_lineage(blocks.groupBy("block").applyInPandas(_screen_block(percent), BLOCK_ROWS))
    across = with_texts(docs, classes, work).groupBy("block").applyInPandas(_exact_block(k, percent), "a long, b long")
    across = cut_lineage(across)
    release(spark)
    ends = cut_lineage(components(stars.unionByName(across)))
    own = classes.select("cid", "first_id").join(ends, F.col("cid") == F.col("node"), "left")
    own = cut_lineage(own.select("cid", "first_id", F.coalesce("root", "cid").alias("root")))
    least = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = own.select("cid", "root").join(least, "root").select(F.col("cid").alias("_cid"), "component_id")
    told = rows.join(named, F.col("cid") == F.col("_cid"), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return told.select("doc_id", "row", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       component.eqNullSafe(F.col("doc_id")).alias("kept"))
