"""Sharding by histogram sort: equal bytes per shard along one order, with one exchange.

Rows are ordered by (hash of the text, hash of the id, position), so equal texts stand together and a group
of any size can still be cut. Splitters are found by probing: each round counts the exact bytes between
equally spaced probes inside the interval that still holds a splitter, and narrows that interval, until the
bytes below every splitter are within the tolerance of their aim or a single row is left. Where one key
holds too much, probing goes on along the next part of the order. Each round is one aggregation of at most
``probes`` counters per shard; the driver sees counters only.

Slots number the rows of a shard without a gap: rows are counted per cell (a stretch of the order, split
further by a hash where it is crowded), cells get offsets, and rows are numbered inside their cell.

Only DataFrame functions are used. Defined results: a null text has size ``overhead`` and no CRC; repeated
rows are rows like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywork.llm.common import take, written

LAST = (1 << 63) - 1
KEYS = ("_k0", "_k1", "_k2")


def before(bound: tuple[int, ...], keys=KEYS) -> Column:
    """Rows that stand before ``bound`` in the order of the keys; a short bound is one for its prefix."""
    told = None
    for key, value in reversed(list(zip(keys, bound))):
        here = F.col(key) < F.lit(value)
        told = here if told is None else here | ((F.col(key) == F.lit(value)) & told)
    return told


def place(bounds: list[tuple[int, ...]], low: int = 0) -> Column:
    """How many of the sorted ``bounds`` stand at or before the row, by halving."""
    if not bounds:
        return F.lit(low)
    mid = len(bounds) // 2
    return F.when(before(bounds[mid]), place(bounds[:mid], low)).otherwise(place(bounds[mid + 1 :], low + mid + 1))


def after(prefix: tuple[int, ...], value: int) -> tuple[int, ...]:
    """The bound just behind everything up to ``value`` below ``prefix``."""
    while value >= LAST and prefix:
        *head, value = prefix
        prefix = tuple(head)
    return (*prefix, min(value + 1, LAST))


def splitters(rows: DataFrame, shards: int, tolerance: float, probes: int) -> tuple[list[tuple[int, ...]], int]:
    """Bounds between the shards, and the number of rows."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not total:
        return [(LAST,)] * (shards - 1), n
    allowed = tolerance * total / shards
    found: dict[int, tuple[int, ...]] = {}
    # per splitter: keys fixed so far, range of the next key, bytes below that range
    state = {i: ((), 0, LAST, 0) for i in range(1, shards)}
    while state:
        intervals = sorted({(prefix, low, high) for prefix, low, high, _ in state.values()}, key=lambda x: (*x[0], x[1]))
        width = {x: (x[2] - x[1]) // probes + 1 for x in intervals}
        number = place([(*prefix, low) for prefix, low, _ in intervals]) - 1
        # one row per interval, so at most one per shard
        told = rows.sparkSession.createDataFrame(
            [(k, len(p), *(*p, 0, 0)[:2], low, high, width[p, low, high]) for k, (p, low, high) in enumerate(intervals)],
            "_i int, _level int, _p0 long, _p1 long, _low long, _high long, _step long")
        key = F.when(F.col("_level") == 0, F.col("_k0")).when(F.col("_level") == 1, F.col("_k1")).otherwise(F.col("_k2"))
        counted = rows.withColumn("_i", number).join(F.broadcast(told), "_i").where(
            key.between(F.col("_low"), F.col("_high")) & ((F.col("_level") < 1) | (F.col("_k0") == F.col("_p0")))
            & ((F.col("_level") < 2) | (F.col("_k1") == F.col("_p1"))))
        counted = counted.select("_i", "size", (key - F.col("_low")).alias("_x"), "_step").selectExpr("_i", "size", "_x div _step AS _bucket")
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in counted.groupBy("_i", "_bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            counts.setdefault(r["_i"], {})[r["_bucket"]] = (r["b"], r["n"])  # shards * probes at most
        narrowed = {}
        for i, (prefix, low, high, below) in state.items():
            interval, aim = (prefix, low, high), total * i / shards
            own, step, under = counts.get(intervals.index(interval), {}), width[interval], below
            for bucket_no in sorted(own):
                held, rows_held = own[bucket_no]
                if under + held >= aim:
                    break
                under += held
            start = low + bucket_no * step
            stop = min(high, start + step - 1)
            left, right = aim - under, under + held - aim
            if min(left, right) <= allowed or rows_held == 1:
                found[i] = (*prefix, start) if left <= right else after(prefix, stop)
            elif start == stop:
                narrowed[i] = ((*prefix, start), 0, LAST, under)
            else:
                narrowed[i] = (prefix, start, stop, under)
        state = narrowed
    return [found[i] for i in range(1, shards)], n


def numbered(rows: DataFrame, n: int, cell_rows: int) -> DataFrame:
    """Add ``slot``: 0, 1, ... inside each shard."""
    cells = min(1 << 16, max(1, n // cell_rows))
    celled = rows.withColumn("_cell", F.expr(f"_k0 div {LAST // cells + 1}"))
    crowd = celled.groupBy("shard", "_cell").agg(F.ceil(F.count("*") / cell_rows).alias("_parts"))
    on = ["shard", "_cell"]
    # cells: at most 65536 and one more for each shard
    parted = celled.join(F.broadcast(crowd), on).withColumn("_part", F.pmod(F.xxhash64("_k1", "_k2"), F.col("_parts")))
    earlier = W.partitionBy("shard").orderBy("_cell", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parted.groupBy(*on, "_part").agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = W.partitionBy(*on, "_part").orderBy(*KEYS)
    slots = parted.withColumn("_row", F.row_number().over(inside)).join(offsets, [*on, "_part"])
    return slots.withColumn("slot", F.col("_offset") + F.col("_row") - 1)


def shard(
    df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", overhead: int = 16,
    tolerance: float = 0.001, probes: int = 1024, cell_rows: int = 200_000, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, and the columns named in ``carry``.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``. The bytes of every shard are within
    ``tolerance`` of an equal share, or as near as whole rows allow.
    """
    raw = F.col("text").cast("binary")
    rows = take(df, doc_id=doc_id, text=text, **{f"_c{i}": c for i, c in enumerate(carry)})
    half = lambda *c: F.shiftrightunsigned(F.xxhash64(*c), 1)  # noqa: E731  whole numbers from 0
    keyed = rows.select(
        "doc_id", *[f"_c{i}" for i in range(len(carry))],
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), half("text").alias("_k0"), half("doc_id").alias("_k1"),
        F.monotonically_increasing_id().alias("_k2"))
    keyed = written(keyed, "shard-keys")  # read by every round, and the positions stay what they are
    bounds, n = splitters(keyed.select("size", *KEYS), shards, tolerance, probes)
    dealt = keyed.withColumn("shard", place(bounds).cast("int"))
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)]
    return numbered(dealt, n, cell_rows).select("doc_id", "size", "text_crc32", "shard", "slot", *own)
