"""The trie of conversation prefixes, where only prefixes that may be shared are shuffled for grouping.

A node is a distinct sequence of the first d turns (role and text), a member a conversation that starts with it.

1. Turns shrink to 128 bits of hash and a number of words where they are read; texts are never moved. Turns
   are numbered, and prefixes digested (two polynomials of 64 bits over the turns' hashes), in one order over
   all rows cut into ranges, not by conversation: a conversation that holds a third of all turns is spread over
   many tasks. One row per range carries the state of a conversation that crosses it.
2. Screening. A count-min sketch of all prefix digests (two rows of cells that count to two) is merged from one
   per task. It never counts too few, so an estimate of one proves a prefix of a single conversation. So do all
   longer prefixes; such tails are nodes as they stand and are emitted where they are.
3. Prefixes with a larger estimate, and the first node of each tail (its parent may be shared), are grouped
   exactly. The sketch has 8 cells a prefix, ``CELLS`` at most; beyond that more prefixes are grouped, all right.
4. Sums over subtrees need no walk. A conversation is smallest member of its nodes from some depth on; there, and
   only there, its turns are counted as nodes. With sums of words along each conversation every prefix row knows
   what its conversation adds to the node's subtree, and one aggregation adds that up. Leaves likewise: each has
   one conversation, its smallest member, that counts for all nodes on its way.
5. The hash over the members that end in a node reads them in order: rows are sorted in ranges by node and id, a
   node inside a range is hashed there, the others leave packed chunks that are hashed one after the other.

Defined results: turns are ordered by turn (null first); equal turn numbers by the hash of role and text; null
role or text is empty; repeated rows are turns of their own; rows without conv_id are in no conversation and
left out; texts of any length are turns like others; an empty table gives an empty table; other columns are not
read. Digests decide which prefixes are equal (2 x 64 bits and the depth).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import mixed, release, take, trim, written
from tallywork.llm.cube_mix import words
from tallywork.session import cut_lineage

# Odd bases of the two polynomials; cells of a row of the sketch at most; bytes of a piece of it, of a chunk of ids.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
CELLS, PIECE, CHUNK = 1 << 25, 1 << 13, 1 << 20
RANGE_ROWS = 1 << 20
KEY = ["k1", "k2", "depth"]
WORD = (1 << 64) - 1


def in_ranges(df: DataFrame, rows: int, *order) -> DataFrame:
    """All rows in one order, cut into ranges."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // RANGE_ROWS)
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _segments(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of equal ids begin, and for each row the row its stretch begins with."""
    new = np.concatenate(([True], ids[1:] != ids[:-1]))
    at = np.flatnonzero(new)
    return at, at[np.cumsum(new) - 1]


def _number(batches):
    """Place of each turn in its conversation, as far as this range shows."""
    part, conv, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        at, first = _segments(ids)
        local = np.arange(len(ids)) - first
        if conv == ids[0]:
            local[: at[1] if len(at) > 1 else len(ids)] += held
        conv, held = ids[-1], int(local[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), part, np.int32)), pa.array(local, pa.int64()), *(batch.column(c) for c in ("conv_id", "d1", "d2", "words"))],
            names=["part", "local", "conv_id", "d1", "d2", "words"])


def _chain(batches):
    """Depth, digest and words of each prefix, and the digest before, as far as this range shows."""
    part = TaskContext.get().partitionId()
    conv, depth, sums, cum = None, 0, [0, 0], 0
    waiting = None

    def out(columns, last):
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (np.full(len(last), part, np.int32), *columns)] + [pa.array(last)],
            names=["part", "conv_id", "local", "s1", "s2", "p1", "p2", "words", "cum", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n = batch.column("conv_id").to_numpy(), batch.num_rows
        at, first = _segments(ids)
        local = np.arange(n) - first
        goes_on = int(at[1]) if len(at) > 1 else n
        old = conv == ids[0]
        every = []
        for lane, base in enumerate(BASES):
            power = np.full(n, base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)[local]
            if old:
                power[:goes_on] *= np.uint64(pow(base, depth, 1 << 64))
            digest = mixed(batch.column(f"d{lane + 1}").to_numpy().view(np.uint64) + np.uint64(lane + 1))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(digest * power)))
            own = total[1:] - total[first]
            before = total[:-1] - total[first]
            if old:
                own[:goes_on] += np.uint64(sums[lane])
                before[:goes_on] += np.uint64(sums[lane])
            every += [own, before]
        number = batch.column("words").to_numpy()
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(number)))
        held = total[1:] - total[first]
        if old:
            local[:goes_on] += depth
            held[:goes_on] += cum
        last = np.concatenate((ids[1:] != ids[:-1], [True]))
        if waiting is not None:
            waiting[1][-1] = not old
            yield out(*waiting)
        waiting = ([ids, local, every[0].view(np.int64), every[2].view(np.int64), every[1].view(np.int64), every[3].view(np.int64), number, held], last)
        conv, depth, sums, cum = ids[-1], int(local[-1]) + 1, [int(every[0][-1]), int(every[2][-1])], int(held[-1])
    if waiting is not None:  # whether the last conversation goes on in the next range is told by the carries
        yield out(*waiting)


CHAIN = "part int, conv_id long, local long, s1 long, s2 long, p1 long, p2 long, words long, cum long, last boolean"


def edges(rows: DataFrame, *state: str) -> list:
    """Of each range its first and last conversation and the last row's state: one row per range."""
    return sorted(rows.groupBy("part").agg(
        F.min("conv_id").alias("first"), F.max("conv_id").alias("final"),
        F.max_by(F.struct("local", *state), F.struct("conv_id", "local")).alias("state")).collect(), key=lambda r: r["part"])


def carries(ranges: list) -> dict[int, tuple]:
    """For each range that begins inside a conversation: the rows, sums and words of it that lie before."""
    out, before, final = {}, None, None
    for r in ranges:
        own = (r["state"]["local"] + 1, *(r["state"][c] for c in ("s1", "s2", "cum"))) if "s1" in r["state"] else (r["state"]["local"] + 1, 0, 0, 0)
        if final is not None and final == r["first"]:
            out[r["part"]] = before
            if r["first"] == r["final"]:
                own = combined(before, own)
        before, final = own, r["final"]
    return out


def combined(before: tuple, own: tuple) -> tuple:
    """State behind ``own`` rows that follow ``before``."""
    sums = [(before[i + 1] + own[i + 1] * pow(base, before[0], 1 << 64)) & WORD for i, base in enumerate(BASES)]
    return (before[0] + own[0], *sums, before[3] + own[3])


class Carried:
    """Adds what lies before a range to the rows of a conversation that crosses into it."""

    def __init__(self, ranges: list):
        self.before = carries(ranges)
        self.first = {r["part"]: r["first"] for r in ranges}
        follows = zip(ranges, ranges[1:])
        self.goes_on = {a["part"]: a["final"] for a, b in follows if a["final"] == b["first"]}

    def rows(self, batch) -> dict[str, np.ndarray]:
        x = {c: batch.column(c).to_numpy(zero_copy_only=False).copy() for c in batch.schema.names}
        for c in ("s1", "s2", "p1", "p2"):
            x[c] = x[c].view(np.uint64)
        x["before"] = x["cum"] - x["words"]
        for part in np.unique(x["part"]).tolist():
            if part in self.before:
                n, *sums, cum = self.before[part]
                own = (x["part"] == part) & (x["conv_id"] == self.first[part])
                for i, base in enumerate(BASES):
                    by = np.uint64(pow(base, n, 1 << 64))
                    for c in (f"s{i + 1}", f"p{i + 1}"):
                        x[c][own] = x[c][own] * by + np.uint64(sums[i] & WORD)
                x["local"][own] += n
                x["before"][own] += cum
            if part in self.goes_on:
                x["last"][(x["part"] == part) & (x["conv_id"] == self.goes_on[part])] = False
                # rows before the range's last one had no mark anyway
        return x


def cells(s1: np.ndarray, s2: np.ndarray, depth: np.ndarray, wide: int) -> list[np.ndarray]:
    """The cell of each prefix in either row of the sketch."""
    by = mixed(depth.astype(np.uint64))
    return [(mixed(s ^ by) & np.uint64(wide - 1)).astype(np.int64) for s in (s1, s2)]


def _count(carried, wide: int):
    def run(batches):
        once, twice = np.zeros((2, wide), bool), np.zeros((2, wide), bool)
        for batch in batches:
            x = carried.value.rows(batch)
            deep = x["local"] > 0
            for lane, cell in enumerate(cells(x["s1"][deep], x["s2"][deep], x["local"][deep], wide)):
                cell, n = np.unique(cell, return_counts=True)
                twice[lane, cell] |= once[lane, cell] | (n > 1)
                once[lane, cell] = True
        a, b = (np.packbits(m).reshape(-1, min(PIECE, wide // 4)) for m in (once, twice))
        full = np.flatnonzero(a.any(axis=1))
        for start in range(0, len(full), 64):
            own = full[start : start + 64]
            yield pa.RecordBatch.from_arrays([
                pa.array(own, pa.int32()), pa.array([a[i].tobytes() for i in own], pa.binary()),
                pa.array([b[i].tobytes() for i in own], pa.binary())], names=["piece", "once", "twice"])
        trim()

    return run


def _merge(batches):
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("piece", "once", "twice"))):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if piece in held:
                a, b = held[piece][0] | a, held[piece][1] | b | (held[piece][0] & a)
            held[piece] = (a, b)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.int32()), pa.array([b.tobytes() for _, b in held.values()], pa.binary())], names=["piece", "twice"])


def sketch(chained: DataFrame, carried, wide: int) -> np.ndarray:
    """Which cells count two or more: bits, 8 MB at most."""
    own = chained.mapInArrow(_count(carried, wide), "piece int, once binary, twice binary")
    pieces = own.repartition("piece").mapInArrow(_merge, "piece int, twice binary").collect()
    out = np.zeros((2 * wide // 8 // min(PIECE, wide // 4), min(PIECE, wide // 4)), np.uint8)
    for r in pieces:
        out[r["piece"]] = np.frombuffer(bytes(r["twice"]), np.uint8)
    return out.reshape(2, -1)


def _split(carried, screen, wide: int):
    """Prefix rows with their kind: 0 may be shared, 1 first of a tail, 2 further down a tail."""

    def run(batches):
        bits = screen.value

        def several(s1, s2, depth):
            told = depth <= 0
            in_both = np.ones(len(depth), bool)
            for lane, cell in enumerate(cells(s1, s2, depth, wide)):
                in_both &= (bits[lane, cell >> 3] >> (7 - (cell & 7))) & 1 > 0
            return told | in_both

        for batch in batches:
            x = carried.value.rows(batch)
            depth = x["local"]
            own, above = several(x["s1"], x["s2"], depth), several(x["p1"], x["p2"], depth - 1)
            kind = np.where(own, 0, np.where(above, 1, 2)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([
                pa.array(kind), pa.array(x["conv_id"]), pa.array(depth), *(pa.array(x[c].view(np.int64)) for c in ("s1", "s2", "p1", "p2")),
                pa.array(x["before"]), pa.array(x["words"]), pa.array(x["last"])],
                names=["kind", "conv_id", "depth", "k1", "k2", "q1", "q2", "before", "words", "last"])

    return run


SPLIT = "kind byte, conv_id long, depth long, k1 long, k2 long, q1 long, q2 long, before long, words long, last boolean"


def _seal(batches):
    """Hashes of nodes that lie inside this range, chunks of ids of the others."""
    node, text, first, opened, count = None, [], None, False, 0

    def row(key, sha, first, ids):
        return (*key, sha, first, ids)

    def out(rows):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*KEY, "sha", "first", "ids"])

    def ended(final):
        """The node's last row: a hash, or a chunk if the node may go beyond the range."""
        ids = b",".join(text)
        if opened or final or count == 1:
            return row(node, None, first, ids)
        return row(node, hashlib.sha256(ids).hexdigest(), None, None)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        new = np.ones(len(ids), bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        at, rows = [*np.flatnonzero(new).tolist(), len(ids)], []
        for a, b in zip(at[:-1], at[1:]):
            key = tuple(int(k[a]) for k in keys)
            if key != node:
                if node is not None and text:
                    rows.append(ended(False))
                node, text, first, opened, count = key, [], int(ids[a]), False, count + 1
            for start in range(a, b, CHUNK // 16):
                piece = ids[start : min(b, start + CHUNK // 16)].tolist()
                first = piece[0] if not text else first
                text.append(",".join(map(str, piece)).encode())
                if sum(map(len, text)) > CHUNK:
                    rows.append(row(node, None, first, b",".join(text)))
                    text, opened = [], True
        if rows:
            yield out(rows)
    if node is not None and text:
        yield out([ended(True)])


def _stitch(batches):
    """Chunks sorted by node and first id -> one hash per node."""
    node, sha = None, None
    for batch in batches:
        rows = []
        keys = zip(*(batch.column(c).to_pylist() for c in KEY))
        for key, ids in zip(keys, batch.column("ids")):
            if key != node:
                if node is not None:
                    rows.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.as_py())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[*KEY, "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, sha.hexdigest())], names=[*KEY, "sha"])


def ends_hash(ends: DataFrame, rows: int) -> DataFrame:
    """k1, k2, depth, sha: of each node's conv_ids (``ends`` has a row for each), ascending."""
    sorted_ = in_ranges(ends.select(*KEY, "conv_id"), rows, *KEY, "conv_id")
    sealed = cut_lineage(sorted_.mapInArrow(_seal, "k1 long, k2 long, depth long, sha string, first long, ids binary"))
    chunks = sealed.where("sha is null").repartition(*KEY).sortWithinPartitions(*KEY, "first")
    stitched = chunks.select(*KEY, "ids").mapInArrow(_stitch, "k1 long, k2 long, depth long, sha string")
    return sealed.where("sha is not null").select(*KEY, "sha").unionByName(stitched)


def prefixes(turns: DataFrame, base: Column | None, head: Column | None, most: int) -> tuple[DataFrame, int]:
    """conv_id, place, d1, d2, words: all turns of all conversations and a row before the first; and their number.

    With ``base`` and ``head`` a conversation's first ``head`` turns (``most`` at most) are those of ``base``;
    only conversations that are their own base are one for others.
    """
    spark = turns.sparkSession
    body = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *body)
    slim = slim.select("conv_id", "turn", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(7), "text", "role").alias("d2"),
                       F.coalesce(words("text"), F.lit(0)).cast("long").alias("words"))
    slim = written(slim, "trie-turns")
    total = slim.count()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "d1", "d2"]
    numbered = written(in_ranges(slim, total, *order).mapInArrow(
        _number, "part int, local long, conv_id long, d1 long, d2 long, words long"), "trie-places")
    ranges = edges(numbered)
    before, first = carries(ranges), {r["part"]: r["first"] for r in ranges}
    shift = spark.createDataFrame([(p, first[p], b[0]) for p, b in before.items()], "_part int, _conv long, _shift long")
    placed = numbered.join(F.broadcast(shift), (F.col("part") == F.col("_part")) & (F.col("conv_id") == F.col("_conv")), "left")
    placed = placed.select("conv_id", (F.col("local") + F.coalesce("_shift", F.lit(0))).alias("place"), "d1", "d2", "words")
    nothing = F.lit(0).cast("long")
    top = placed.where("place = 0").select("conv_id", F.lit(-1).cast("long").alias("place"), nothing.alias("d1"), nothing.alias("d2"), nothing.alias("words"))
    if base is None:
        return placed.unionByName(top), 2 * total
    own = placed.where((F.col("place") >= head) | (F.col("conv_id") == base))
    heads = placed.where((F.col("place") < most) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "_base")
    taking = placed.where("place = 0").select("conv_id", base.alias("_of"), head.alias("_head")).where("_head > 0 and conv_id <> _of")
    taken = taking.join(heads, (F.col("_of") == F.col("_base")) & (F.col("place") < F.col("_head"))).select(*placed.columns)
    return own.unionByName(taken).unionByName(top), (2 + most) * total


def trie(turns: DataFrame, base: Column | None = None, head: Column | None = None, most: int = 3) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, turn, role, text), with members, children, leaves and savings.

    saved_tokens are the words that a cache of prefixes spares: over the subtree, each node's last turn times its
    members but one. ends_sha256 hashes the ids of the members that end in the node.
    """
    spark = turns.sparkSession
    rows, total = prefixes(take(turns, conv_id="conv_id", turn="turn", role="role", text="text"), base, head, most)
    chained = written(in_ranges(rows, total, "conv_id", "place").mapInArrow(_chain, CHAIN), "trie-prefixes")
    carried = spark.sparkContext.broadcast(Carried(edges(chained, "s1", "s2", "cum")))
    wide = min(CELLS, 1 << max(13, (8 * chained.count() - 1).bit_length()))
    screen = spark.sparkContext.broadcast(sketch(chained, carried, wide))
    split = written(chained.mapInArrow(_split(carried, screen, wide), SPLIT), "trie-kinds")
    release(spark)
    shared, stubs, tails = (split.where(F.col("kind") == k) for k in range(3))
    nodes = cut_lineage(shared.groupBy(*KEY).agg(
        F.min("conv_id").alias("smallest"), F.count("*").alias("n_convs"), F.min("last").alias("all_end"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2")))
    top = nodes.where("depth = 0").first()
    # rows with their node; the root's rows need no join
    named = nodes.select(*(F.col(c).alias(f"_{c}") for c in KEY), "smallest", "all_end").where("_depth > 0")
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("depth") == F.col("_depth"))
    met = shared.where("depth > 0").join(named, same).drop("_k1", "_k2", "_depth")
    met = met.unionByName(shared.where("depth = 0").withColumns({
        "smallest": F.lit(top["smallest"] if top else None).cast("long"), "all_end": F.lit(top["all_end"] if top else None).cast("boolean")}))
    is_first = F.col("smallest") == F.col("conv_id")
    told = met.select("conv_id", "depth", "before", "words", is_first.alias("is_first"), (is_first & F.col("last") & F.col("all_end")).alias("leaf"))
    alone = stubs.select("conv_id", "depth", "before", "words", F.lit(True).alias("is_first"), F.lit(True).alias("leaf"))
    own = told.unionByName(alone).groupBy("conv_id").agg(
        F.min(F.when(F.col("is_first"), F.struct("depth", "before"))).alias("own"), F.max(F.col("before") + F.col("words")).alias("end"),
        F.max("leaf").alias("leaf"))
    # words of the conversation that lie before its own nodes: there it is one more member, not a node
    own = cut_lineage(own.select(F.col("conv_id").alias("_conv"), F.coalesce("own.before", "end").alias("until"), "leaf"))
    adds = F.greatest(F.lit(0), F.col("until") - F.col("before"))
    sums = shared.join(own, F.col("conv_id") == F.col("_conv")).groupBy(*KEY).agg(
        F.sum(adds).alias("saved_tokens"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"))
    above = [F.col("q1").alias("k1"), F.col("q2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    below = nodes.where("depth > 0").select(*above).unionByName(stubs.select(*above))
    children = below.groupBy(*KEY).agg(F.count("*").alias("n_children"))
    ends = ends_hash(shared.where("last"), total)
    nothing = hashlib.sha256(b"").hexdigest()
    grouped = nodes.join(sums, KEY).join(children, KEY, "left").join(ends, KEY, "left").select(
        F.col("smallest").alias("conv_id"), "depth", "q1", "q2", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(nothing)).alias("ends_sha256"))

    def single(df: DataFrame) -> DataFrame:
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        end = F.sha2(F.col("conv_id").cast("string"), 256)
        return df.select("conv_id", "depth", "q1", "q2", one.alias("n_convs"), F.when(F.col("last"), none).otherwise(one).alias("n_children"),
                         one.alias("n_leaves"), none.alias("saved_tokens"), F.when(F.col("last"), end).otherwise(F.lit(nothing)).alias("ends_sha256"))

    parents = nodes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("depth") + 1).alias("_depth"), F.col("smallest").alias("_parent"))
    up = (F.col("q1") == F.col("_k1")) & (F.col("q2") == F.col("_k2")) & (F.col("depth") == F.col("_depth"))
    some = cut_lineage(grouped.unionByName(single(stubs)))
    deep = some.where("depth > 1").join(parents.where("_depth > 1"), up, "left").withColumn("parent", F.coalesce("_parent", "conv_id"))
    shallow = some.where("depth <= 1").withColumn("parent", F.when(F.col("depth") == 1, F.lit(top["smallest"] if top else None).cast("long")))
    out = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return deep.select(*out).unionByName(shallow.select(*out)).unionByName(single(tails).withColumn("parent", F.col("conv_id")).select(*out))
