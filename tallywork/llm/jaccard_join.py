"""N-gram Jaccard join with a token-group matrix: exact, and without all pairs of anything.

Every text becomes the set of its word shingles (64-bit hashes). Equal sets are one class. Then:

1. Near classes are partitioned into groups. Classes that agree in a pair of minimum hashes (two pairs are
   tried) share blocks of bounded size; every block of such a family also holds the family's pivot, its most
   copied class. Blocks are joined exactly, and the components of the links found are the groups, so a family
   of any size becomes one group through its pivot instead of all its pairs.
2. Token-group matrix. Each group, in parts of bounded size, is entered under the union of its members' rarest
   tokens (rare by a count sketch over all texts); each class looks up its own rarest tokens, and meets only
   parts of other groups. Two sets of the wanted similarity share a number of those tokens that follows from
   their sizes; the matrix counts what query and part share, and parts that share too few are not opened.
3. A query opens a part only if some member can be near enough by a parity bitmap: cells of a set that hold an
   odd number of its tokens. Two bitmaps differ in no more cells than the sets differ in tokens, so no link is
   lost, and a bitmap is a fraction of a text. Texts are fetched for those queries and members only. The query
   must then share enough tokens with the union of these members; then each of them is checked exactly.

Components of all links give each document the smallest doc_id it is connected with. No link is lost: a link
between two texts either lies inside a group or is met in step 2.

Defined results: null texts and texts without words have no shingles and are linked with nothing (their
component is their own id); texts with fewer words than a shingle are one shingle as a whole; repeated rows
share their class; a null doc_id never names a component, so a class of null ids only has a null one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from tallywork.llm.common import mixed, only_cells, pieces, slices, take, trim, written
from tallywork.llm.components import components
from tallywork.session import cut_lineage

# Any odd numbers: base of the polynomial over bytes, factors of the words of a shingle, of minimum hashes.
BASE = 0x5851F42D4C957F2D
FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & (1 << 64) - 1 for i in range(64)], np.uint64)
MINIMA = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))
# Bits of the count sketch and pieces it is moved in; members of a block and of a part of a group.
SKETCH_BITS, SKETCH_BLOCKS, BLOCK, PART = 20, 64, 48, 32
# Bytes of text that are hashed at a time.
HASHED = 1 << 18
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0..n-1 modulo 2 ** 64, and of its inverse."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles."""
    raw = [(t or "").encode("utf-8", "replace").lower() for t in texts]  # lower() of bytes is A-Z only
    out: list[np.ndarray] = []
    for start, stop in pieces(raw, HASHED):
        data = np.frombuffer(b" " + b" ".join(raw[start:stop]) + b" ", np.uint8)
        forth, back = powers(len(data) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[:-1])))
        space = IS_SPACE[data]
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = mixed((sums[end] - sums[first]) * back[first])
        cuts = np.cumsum([1] + [len(t) + 1 for t in raw[start:stop]])
        at = np.searchsorted(first, cuts)
        shingles = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k if len(shingles) else 0):
            shingles += words[i : len(words) - k + 1 + i] * FACTORS[i]
        shingles = mixed(shingles)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(shingles[a : b - k + 1]))
            elif b > a:
                own = np.concatenate((words[a:b], np.full(1, b - a, np.uint64)))
                out.append(mixed((own * FACTORS[k + 1 : k + 1 + len(own)]).sum(dtype=np.uint64, keepdims=True)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_id(tokens: np.ndarray) -> int:
    """A 64-bit name of a set (signed)."""
    sums = np.concatenate((mixed(tokens ^ FACTORS[0]), np.full(1, len(tokens), np.uint64) * FACTORS[1]))
    return int(mixed(sums.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _digest(k: int, id_type: pa.DataType):
    """Per document the size, name and minimum hashes of its set; at the end of a task its count sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            tokens = np.concatenate([np.zeros(0, np.uint64), *sets])
            counts += np.bincount((tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            least = [[mixed(s * m).min() if len(s) else np.uint64(0) for s in sets] for m in MINIMA]
            minima = [mixed(np.array(a, np.uint64) ^ mixed(np.array(b, np.uint64))).view(np.int64) for a, b in zip(least[::2], least[1::2])]
            n = len(sets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("row"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([class_id(s) if len(s) else None for s in sets], pa.int64()),
                *(pa.array(m) for m in minima), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
            ], names=NAMES)
        rows = np.minimum(counts, 65535).astype("<u2").reshape(SKETCH_BLOCKS, -1)
        n = len(rows)
        trim()
        yield pa.RecordBatch.from_arrays([
            pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(5)),
            pa.array(range(n), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary()),
        ], names=NAMES)

    return run


NAMES = ["doc_id", "row", "n", "cid", "m0", "m1", "block", "cells"]


def _sum_sketches(batches):
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, cells in zip(batch.column("block").to_pylist(), batch.column("cells").to_pylist()):
            own = np.frombuffer(cells, "<u2").astype(np.int64)
            totals[block] = totals[block] + own if block in totals else own
    yield pa.RecordBatch.from_arrays([
        pa.array(list(totals), pa.int32()), pa.array([t.astype("<i8").tobytes() for t in totals.values()], pa.binary())],
        names=["block", "cells"])


def rarity(digests: DataFrame) -> np.ndarray:
    """How common each of the sketch's cells is over all texts, in steps of the square root of two."""
    blocks = digests.where("block is not null").select("block", "cells").repartition(SKETCH_BLOCKS, "block")
    rows = blocks.mapInArrow(_sum_sketches, "block int, cells binary").collect()  # 64 rows, 8 MB together
    counts = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in rows:
        counts[r["block"]] = np.frombuffer(bytes(r["cells"]), "<i8")
    return np.floor(2 * np.log2(counts.reshape(-1) + 1)).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    """Of a set of ``n`` tokens so many of the rarest are looked up: any similar set, smaller or equal, has one."""
    return n - -(-percent * n // 100) + 1


def _postings(k: int, percent: int, levels):
    """token, class: the rarest tokens of every set, once per class and task."""

    def run(batches):
        level, seen = levels.value, set()
        for batch in (part for whole in batches for part in slices(whole)):
            tokens, names = [], []
            for s in shingle_sets(batch.column("text").to_pylist(), k):
                if not len(s) or (cid := class_id(s)) in seen:
                    continue
                seen.add(cid)
                rare = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                own = s[np.argsort((rare << np.uint64(56)) | (s >> np.uint64(8)))[: prefix_length(len(s), percent)]]
                tokens.append(own.view(np.int64))
                names.append(np.full(len(own), cid, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (tokens, names)], names=["token", "cid"])
        trim()

    return run


def parity(tokens: np.ndarray) -> bytes:
    """A bit for each of a power of two of cells: whether it holds an odd number of tokens."""
    cells = 1 << max(9, (2 * len(tokens)).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: np.ndarray, wide: int) -> np.ndarray:
    """Parity bitmaps (one a row) for fewer cells."""
    return np.bitwise_xor.reduce(bits.reshape(len(bits), -1, wide), axis=1)


def most_apart(n, m, percent: int):
    """In how many tokens two linked sets of ``n`` and ``m`` tokens can differ."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _signs(k: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            signs = [parity(s) for s in shingle_sets(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([pa.array(signs, pa.binary()), batch.column("_key")], names=["sign", "_key"])
        trim()

    return run


def _bound_block(percent: int):
    """Of a block's queries and members, those that have a partner within the bound of their bitmaps."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["cid", "query"]).reset_index(drop=True)
        asks, n = group["query"].to_numpy(bool), group["n"].to_numpy(np.int64)
        bits = [np.frombuffer(s, np.uint8)[None, :] for s in group["sign"]]
        wide, stays = np.array([b.shape[1] for b in bits]), np.zeros(len(group), bool)
        for size in np.unique(wide[~asks]):
            members = np.flatnonzero(~asks & (wide == size))
            stack = {int(size): np.concatenate([bits[j] for j in members])}
            for i in np.flatnonzero(asks):
                at = int(min(size, wide[i]))
                if at not in stack:
                    stack[at] = folded(stack[int(size)], at)
                apart = np.bitwise_count(stack[at] ^ folded(bits[i], at)).sum(axis=1, dtype=np.int64)
                near = apart <= most_apart(n[i], n[members], percent)
                stays[members[near]] = True
                stays[i] |= bool(near.any())
        return group.loc[stays, ["block", "cid", "query"]]

    return run


def _open_block(k: int, percent: int):
    """Links inside a block: queries against members if there are queries, else all members."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["cid", "query"]).sort_values(["query", "cid"], ignore_index=True)
        sets = shingle_sets(list(group["text"]), k)
        ids, queries = group["cid"].tolist(), group["query"].tolist()
        members = [i for i, q in enumerate(queries) if not q]
        out, root = [], list(range(len(ids)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def test(i, j):
            if find(i) != find(j) and linked(sets[i], sets[j], percent):
                root[find(i)] = find(j)
                out.append((ids[i], ids[j]))

        if len(members) == len(ids):
            for x, i in enumerate(members):
                for j in members[:x]:
                    test(i, j)
        elif members:
            for j in members[1:]:  # a part of one group: its members are connected already
                root[find(j)] = find(members[0])
            union = np.unique(np.concatenate([sets[j] for j in members]))
            for i in range(len(ids)):
                if queries[i] and 100 * int(np.isin(sets[i], union, assume_unique=True).sum()) >= percent * len(sets[i]):
                    for j in members:
                        test(i, j)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def fetched(docs: DataFrame, classes: DataFrame, work: DataFrame, k: int | None = None) -> DataFrame:
    """``work`` (block, cid, query) with the size of each class, and its text or, given ``k``, its parity bitmap."""
    wanted = work.join(classes.select("cid", "rep", "n"), "cid").withColumn("_key", F.xxhash64(F.struct("rep.doc_id", "rep.row")))
    wanted = cut_lineage(wanted.select("block", "cid", "query", "n", "_key"))
    found = only_cells(docs.select("text", F.xxhash64(F.struct("doc_id", "row")).alias("_key")), "_key", wanted)
    if k:
        found = found.mapInArrow(_signs(k), "sign binary, _key long")
    return found.join(wanted, "_key").drop("_key")


def bound_blocks(docs: DataFrame, classes: DataFrame, work: DataFrame, k: int, percent: int) -> DataFrame:
    """The part of ``work`` that the parity bitmaps leave."""
    blocks = fetched(docs, classes, work, k).groupBy("block")
    return cut_lineage(blocks.applyInPandas(_bound_block(percent), "block long, cid long, query boolean"))


def open_blocks(docs: DataFrame, classes: DataFrame, work: DataFrame, k: int, percent: int) -> DataFrame:
    """Fetch the texts of ``work`` (block, cid, query) and return the links found in each block."""
    found = fetched(docs, classes, work).select("block", "cid", "query", "text")
    return cut_lineage(found.groupBy("block").applyInPandas(_open_block(k, percent), "a long, b long"))


def family_blocks(classes: DataFrame) -> DataFrame:
    """block, cid, query: classes with a common pair of minimum hashes, in blocks that all hold the family's pivot."""
    work = []
    for j in range(len(MINIMA) // 2):
        own = classes.select(F.col(f"m{j}").alias("key"), "cid", "copies")
        families = own.groupBy("key").agg(
            F.count("*").alias("k"), F.max(F.struct("copies", "cid"))["cid"].alias("pivot")).where("k > 1")
        families = families.select(F.col("key").alias("_key"), "pivot", F.ceil(F.col("k") / BLOCK).alias("chunks"))
        name = lambda chunk: F.xxhash64(F.lit(j), "_key", chunk)
        members = own.join(families, F.col("key") == F.col("_key")).select(
            name(F.pmod(F.xxhash64("cid"), F.col("chunks"))).alias("block"), "cid")
        pivots = families.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        work += [members, pivots.select(name(F.col("chunk")).alias("block"), F.col("pivot").alias("cid"))]
    out = work[0]
    for more in work[1:]:
        out = out.unionByName(more)
    return out.distinct().withColumn("query", F.lit(False))


def least_shared(n: str, low: str, high: str, percent: int) -> Column:
    """Looked-up tokens that a set of ``n`` shares at least with a similar one of ``low`` to ``high`` tokens.

    Similar sets of n and m tokens share at least a = percent * (n + m) / (100 + percent). Behind the looked-up tokens
    of the set whose last one comes first in the order, at most ceil(percent * max(n, m) / 100) - 1 are left. The
    difference grows with m up to n and falls beyond, so its smallest value is at an end of the sizes. ``low`` and
    ``high`` differ between tokens, but the sizes at a token include those of the members that hold it: the smallest
    bound of the tokens met is no higher than that of a similar member.
    """
    n, low, high = F.col(n), F.col(low), F.col(high)
    below = F.greatest(low, F.ceil(percent * n / 100.0 - 1e-6))
    under = F.ceil(percent * (n + below) / (100.0 + percent) - 1e-6) - F.ceil(percent * n / 100.0 - 1e-6) + 1
    above = F.least(high, F.floor(100.0 * n / percent + 1e-6))
    over = F.floor(percent * (n + above) / (100.0 + percent) - percent * above / 100.0 - 1e-6) + 1
    return F.least(F.when(low <= n, under), F.when(high > n, over))


def matrix_blocks(postings: DataFrame, classes: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """block, cid, query: the parts of groups that each class meets, with the classes that meet them."""
    alone = W.partitionBy("token")
    shared = postings.withColumn("_a", F.min("cid").over(alone)).withColumn("_b", F.max("cid").over(alone))
    shared = shared.where("_a <> _b").select("token", "cid").distinct()
    sizes = roots.groupBy("root").agg(F.ceil(F.count("*") / PART).alias("parts"), F.count("*").alias("size")).withColumnRenamed("root", "_root")
    part = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = cut_lineage(roots.join(sizes, F.col("root") == F.col("_root")).select(
        F.col("node").alias("_node"), "root", part.alias("part"), "size"))
    own = shared.join(classes.select(F.col("cid").alias("_cid"), "n"), F.col("cid") == F.col("_cid"))
    own = own.join(placed, F.col("cid") == F.col("_node"), "left")
    own = own.select("token", "cid", "n", F.coalesce("root", "cid").alias("root"), F.coalesce("part", "cid").alias("part"),
                     F.coalesce("size", F.lit(1).cast("long")).alias("size"))
    # only tokens of several groups can link across; k of them is the most that a class shares with any other group
    own = own.withColumn("_a", F.min("root").over(alone)).withColumn("_b", F.max("root").over(alone)).where("_a <> _b")
    own = cut_lineage(own.withColumn("k", F.count("*").over(W.partitionBy("cid"))).drop("_a", "_b"))
    matrix = own.groupBy(F.col("token").alias("_token"), "part", F.col("root").alias("_root")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("k").alias("_k"), F.max("size").alias("_size"))
    queries = own.select("token", "cid", "n", "root", "k", "size")
    # Classes of the smaller group (by size, then root) look up parts of the larger one, so that a large family is
    # met part by part and its members do not each ask for every outsider.
    asks = (F.col("size") < F.col("_size")) | ((F.col("size") == F.col("_size")) & (F.col("root") < F.col("_root")))
    least = least_shared("n", "low", "high", percent)
    # A similar member shares at least its own bound of tokens, so neither side's k can be below the bound of a token
    # that this member holds: such tokens all stay, and pairs of groups that only share a passage never meet.
    met = queries.join(matrix, F.col("token") == F.col("_token")).where(
        (F.col("root") != F.col("_root")) & asks & (percent * F.col("low") <= 100 * F.col("n")) & (100 * F.col("high") >= percent * F.col("n"))
        & (least <= F.least("k", "_k")))
    met = met.groupBy("cid", "part").agg(F.count("*").alias("c"), F.min(least).alias("least"))
    met = cut_lineage(met.where("c >= least").select("cid", "part"))
    crowd = cut_lineage(met.groupBy(F.col("part").alias("_part")).agg(F.ceil(F.count("*") / BLOCK).alias("chunks")))
    name = lambda chunk: F.xxhash64("part", chunk)
    asking = met.join(crowd, F.col("part") == F.col("_part")).select(
        name(F.pmod(F.xxhash64("cid"), F.col("chunks"))).alias("block"), "cid", F.lit(True).alias("query"))
    opened = crowd.join(placed.withColumnRenamed("part", "_of"), F.col("_part") == F.col("_of"), "left").select(
        F.col("_part").alias("part"), F.coalesce("_node", "_part").alias("cid"), "chunks")
    members = opened.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    members = members.select(name(F.col("chunk")).alias("block"), "cid", F.lit(False).alias("query"))
    return asking.unionByName(members)


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, component_id and kept (one row per component) of every row.

    Documents are linked when 100 * shared shingles >= ``percent`` * shingles of either.
    """
    spark = df.sparkSession
    docs = take(df, doc_id=doc_id, text=text).withColumn("row", F.xxhash64("text"))
    id_type = pa.string() if isinstance(docs.schema["doc_id"].dataType, T.StringType) else (
        pa.int32() if isinstance(docs.schema["doc_id"].dataType, T.IntegerType) else pa.int64())
    kind = docs.schema["doc_id"].dataType.simpleString()
    digests = written(docs.mapInArrow(
        _digest(k, id_type), f"doc_id {kind}, row long, n long, cid long, m0 long, m1 long, block int, cells binary"), "shingle-digests")
    levels = spark.sparkContext.broadcast(rarity(digests))  # one byte for each cell of the sketch
    rows = digests.where("block is null").drop("block", "cells")
    classes = cut_lineage(rows.where("n > 0").groupBy("cid").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")).alias("rep"), F.count("*").alias("copies"),
        F.min("n").alias("n"), F.min("m0").alias("m0"), F.min("m1").alias("m1")))
    inside = open_blocks(docs, classes, family_blocks(classes), k, percent)
    groups = cut_lineage(components(inside))
    postings = docs.mapInArrow(_postings(k, percent, levels), "token long, cid long")
    near = bound_blocks(docs, classes, matrix_blocks(postings, classes, groups, percent), k, percent)
    across = open_blocks(docs, classes, near, k, percent)
    roots = cut_lineage(components(inside.unionByName(across)))
    own = classes.select("cid", "first_id", "rep").join(roots, F.col("cid") == F.col("node"), "left")
    own = cut_lineage(own.select("cid", "first_id", "rep", F.coalesce("root", "cid").alias("root")))
    least = own.groupBy("root").agg(
        F.min("first_id").alias("component_id"), F.min("rep").alias("stays"))
    named = own.select("cid", "root").join(least, "root").select(F.col("cid").alias("_cid"), "component_id", "stays")
    told = rows.join(named, F.col("cid") == F.col("_cid"), "left")
    return told.select(
        "doc_id", "row", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & F.col("row").eqNullSafe(F.col("stays.row")))).alias("kept"))
