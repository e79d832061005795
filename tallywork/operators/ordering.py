"""Order-dependent building blocks that never pull a whole table into one task.

Spark puts a window without partition keys into a single task. Everything here first cuts
the order into ranges whose bounds are plain literals (so a lost executor recomputes the
same ranges), works inside each range, and carries totals between ranges through a table
with one row per range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from tallywork.session import cut_lineage

# Rows of one bracket that a single sort may see when an exact quantile is read off.
BRACKET_ROWS = 50_000
SKETCH = 10_000
# Stretches that a round cuts a group's wide bracket into.
GRID = 200
# Groups up to this number are broadcast.
FEW_GROUPS = 100_000
# Whole-column sketches meet in one task, so they are smaller; another round makes up for it.
WHOLE_SKETCH = 2_000


def stamp_rid(df: DataFrame, out: str = "_rid", from_files: bool = True) -> DataFrame:
    """Number the rows 0..n-1 in file order, without a global sort.

    Frames that read files come out in the same partitions on every computation; any other
    frame is checkpointed first, so that a recomputed partition keeps its numbers. One row
    per partition goes through the driver.
    """
    if not from_files:
        df = cut_lineage(df)
    stamped = df.withColumn(out, F.monotonically_increasing_id())
    part = F.shiftright(F.col(out), 33)
    sizes = stamped.groupBy(part.alias("_p")).count().collect()
    start, offsets = 0, []
    for row in sorted(sizes, key=lambda r: r["_p"]):
        offsets.append((row["_p"], start - (row["_p"] << 33)))
        start += row["count"]
    if not offsets:
        return stamped
    shift = df.sparkSession.createDataFrame(offsets, "_p long, _shift long")
    return (
        stamped.withColumn("_p", part)
        .join(F.broadcast(shift), "_p")
        .withColumn(out, F.col(out) + F.col("_shift"))
        .select(*df.columns, out)
    )


def range_bounds(df: DataFrame, column: str, ranges: int | None = None) -> list[float]:
    """Bounds of roughly equal ranges; a value that fills a range alone gets its own."""
    if ranges is None:
        ranges = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(
        F.percentile_approx(F.col(column).cast("double"), probs, max(SKETCH, 4 * ranges))
    ).first()[0]
    bounds, seen = set(), set()
    for cut in cuts or []:
        if cut in seen:
            bounds.add(math.nextafter(cut, math.inf))
        seen.add(cut)
        bounds.add(cut)
    return sorted(bounds) or [0.0]


def with_range(df: DataFrame, column: str, bounds: list[float], out: str = "_b") -> DataFrame:
    """Add the index of the range that holds ``column`` (not null)."""
    splits = [-math.inf, *[b for b in bounds if math.isfinite(b)], math.inf]
    keyed = df.withColumn("_as_double", F.col(column).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_as_double", outputCol="_range")
    return (
        cut.transform(keyed)
        .withColumn(out, F.col("_range").cast("int"))
        .drop("_as_double", "_range")
    )


def running_sums(
    df: DataFrame, order: str, sums: dict[str, str], by: list[str] | None = None
) -> DataFrame:
    """Add, per row, the sum of ``sums[name]`` over all rows before it in ``order``.

    ``df`` has one row per (by, order): aggregate first, so that a value held by a third
    of all rows is a single row here.
    """
    by = list(by or [])
    cut = with_range(df, order, range_bounds(df, order))
    totals = cut.groupBy(*by, "_b").agg(
        *[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()]
    )
    earlier = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_b",
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums],
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per range
    inside = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    joined = cut.join(offsets, [*by, "_b"])
    for name, c in sums.items():
        joined = joined.withColumn(
            name, F.col(f"_o_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))
        )
    return joined.drop("_b", *[f"_o_{n}" for n in sums])


def dense_ordinal(df: DataFrame, order: str, out: str = "_ord") -> DataFrame:
    """0-based position of every row in ``order`` (unique, not null)."""
    return running_sums(df.withColumn("_one", F.lit(1)), order, {out: "_one"}).drop("_one")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """One row per (by, value): ``n`` rows hold it, ``rank`` is their average rank."""
    by = list(by or [])
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_sums(counts, value, {"_before": "n"}, by)
    return ranked.withColumn("rank", F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def carry(df: DataFrame, order: str, column: str, forward: bool = True) -> DataFrame:
    """Fill nulls of ``column`` from the nearest earlier (or later) row in ``order``."""
    cut = with_range(df, order, range_bounds(df, order))
    pick = F.max_by if forward else F.min_by
    order_at = F.when(F.col(column).isNotNull(), F.col(order))
    ends = cut.groupBy("_b").agg(pick(F.col(column), order_at).alias("_end"))
    outside, inside = W.orderBy("_b"), W.partitionBy("_b").orderBy(order)
    if not forward:  # a frame from its row to the end would be read anew for every row; from the other side it grows
        cut = cut.withColumn("_carry_at", F.row_number().over(inside))
        outside, inside = W.orderBy(F.desc("_b")), W.partitionBy("_b").orderBy(F.desc("_carry_at"))
    near = lambda c, frame, last: F.last(c, ignorenulls=True).over(frame.rowsBetween(W.unboundedPreceding, last))
    ends = ends.select("_b", near("_end", outside, -1).alias("_from_outside"))
    filled = F.coalesce(near(column, inside, 0), F.col("_from_outside"))
    return (
        cut.join(F.broadcast(ends), "_b", "left")  # one row per range
        .withColumn(column, filled)
        .select(*df.columns)
    )


def previous_row(df: DataFrame, order: str, columns: dict[str, str]) -> DataFrame:
    """Add ``columns[c]``: the value of ``c`` in the row just before, over the whole order."""
    cut = with_range(df, order, range_bounds(df, order))
    names = list(columns)
    ends = cut.groupBy("_b").agg(
        F.max_by(F.struct(*names), F.col(order)).alias("_end")
    ).select("_b", F.lag("_end").over(W.orderBy("_b")).alias("_prev_end"))
    inside = W.partitionBy("_b").orderBy(order)
    joined = cut.join(F.broadcast(ends), "_b", "left")  # one row per range
    joined = joined.withColumn("_first", F.row_number().over(inside) == 1)
    for c, out in columns.items():
        joined = joined.withColumn(
            out,
            F.when(F.col("_first"), F.col(f"_prev_end.{c}")).otherwise(F.lag(c).over(inside)),
        )
    return joined.drop("_b", "_prev_end", "_first")


# --------------------------------------------------------------------------- quantiles


def _interpolate(low: Column, high: Column, weight: Column) -> Column:
    return low + (high - low) * weight


def exact_quantiles(
    df: DataFrame, columns: dict[str, Column], probs: list[float]
) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles of whole columns, as driver numbers."""
    return counted_quantiles(df, columns, probs)[0]


def counted_quantiles(df, columns, probs) -> tuple[dict[str, list], dict[str, int]]:
    """Quantiles, and how many values each column holds.

    Each quantile keeps a bracket known to hold its two neighbouring ranks. While a
    bracket holds too many rows it is narrowed by a sketch and re-counted exactly; only
    the rows of the final brackets are grouped and sorted.
    """
    names = list(columns)
    if not names:
        return {}, {}
    # computed once per row here, however often the passes below mention them
    values = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    margin = 5.0 / WHOLE_SKETCH
    points = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    first = values.agg(*[
        f(f"v{i}").alias(f"{label}{i}") for i in range(len(names))
        for label, f in (("n", F.count), ("lo", F.min), ("hi", F.max),
                         ("q", lambda c: F.percentile_approx(c, points, WHOLE_SKETCH)))
    ]).first()
    wants = []  # one bracket per (column, probability)
    for i in range(len(names)):
        total = first[f"n{i}"]
        for p in probs if total else ():
            h = (total - 1) * p
            wants.append(dict(i=i, p=p, h=h, f=math.floor(h), c=math.ceil(h), below=0,
                              inside=total, lo=first[f"lo{i}"], hi=first[f"hi{i}"]))
    is_wide = lambda w: w["inside"] > BRACKET_ROWS and w["lo"] < w["hi"]
    tries = [(w, *first[f"q{w['i']}"][2 * probs.index(w["p"]):][:2]) for w in wants if is_wide(w)]
    while tries and _try(values, tries):
        wide = [w for w in wants if is_wide(w)]
        tries = _sketch(values, wide) if wide else []
    if wants:
        _read_off(values, wants)
    answer = {(w["i"], w["p"]): w["value"] for w in wants}
    found = {n: [answer.get((i, p)) for p in probs] for i, n in enumerate(names)}
    return found, {n: first[f"n{i}"] for i, n in enumerate(names)}


def _within(i: int, lo: float, hi: float) -> Column:
    return (F.col(f"v{i}") >= F.lit(lo)) & (F.col(f"v{i}") <= F.lit(hi))


def _brackets(wants) -> dict[tuple, list[dict]]:
    """Quantiles that still look into the same stretch of the same column."""
    shared: dict[tuple, list[dict]] = {}
    for w in wants:
        shared.setdefault((w["i"], w["lo"], w["hi"]), []).append(w)
    return shared


def _sketch(values, wide) -> list[tuple]:
    """Narrower brackets to try, from a sketch of the rows inside the present ones."""
    margin = 5.0 / WHOLE_SKETCH
    shared = _brackets(wide)
    aggs = []
    for k, ((i, lo, hi), ws) in enumerate(shared.items()):
        points = [
            q for w in ws for q in (
                max(0.0, (w["f"] - w["below"]) / w["inside"] - margin),
                min(1.0, (w["c"] - w["below"] + 1) / w["inside"] + margin))
        ]
        cell = F.when(_within(i, lo, hi), F.col(f"v{i}"))
        aggs.append(F.percentile_approx(cell, points, WHOLE_SKETCH).alias(f"q{k}"))
    guess = values.agg(*aggs).first()
    return [
        (w, guess[f"q{k}"][2 * j], guess[f"q{k}"][2 * j + 1])
        for k, ws in enumerate(shared.values()) for j, w in enumerate(ws)
    ]


def _try(values, tries) -> bool:
    """Count the tried brackets exactly; take those that hold their ranks and are smaller."""
    got = values.agg(*[
        e for t, (w, lo, hi) in enumerate(tries) for e in (
            F.count_if(F.col(f"v{w['i']}") < F.lit(lo)).alias(f"b{t}"),
            F.count_if(_within(w["i"], lo, hi)).alias(f"m{t}"))
    ]).first()
    moved = False
    for t, (w, lo, hi) in enumerate(tries):
        below, inside = got[f"b{t}"], got[f"m{t}"]
        if below <= w["f"] and w["c"] < below + inside and inside < w["inside"]:
            w.update(lo=lo, hi=hi, below=below, inside=inside)
            moved = True
    return moved


def _stretches(wants) -> list[list[dict]]:
    """Quantiles of one column whose brackets overlap, lowest bracket first: a value lies in one stretch at most."""
    found: list[list[dict]] = []
    for w in sorted(wants, key=lambda w: (w["i"], w["lo"])):
        if found and found[-1][0]["i"] == w["i"] and w["lo"] <= max(x["hi"] for x in found[-1]):
            found[-1].append(w)
        else:
            found.append([w])
    return found


def _read_off(values, wants) -> None:
    stretches, which = _stretches(wants), {}
    for k, ws in enumerate(stretches):
        i, inside = ws[0]["i"], _within(ws[0]["i"], ws[0]["lo"], max(w["hi"] for w in ws))
        which[i] = which[i].when(inside, F.lit(k)) if i in which else F.when(inside, F.lit(k))
    # one cell a column, however many quantiles are wanted of it
    cells = F.array(*[F.struct(k.alias("k"), F.col(f"v{i}").alias("v")) for i, k in which.items()])
    counts = values.select(F.inline(cells)).where("k IS NOT NULL").groupBy("k", "v").count()
    spec = values.sparkSession.createDataFrame(
        [(k, ws[0]["below"], w["f"], w["c"], wants.index(w)) for k, ws in enumerate(stretches) for w in ws],
        "k int, below long, f long, c long, want int",
    )
    w = W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    at = counts.withColumn("before", F.coalesce(F.sum("count").over(w), F.lit(0))).join(
        F.broadcast(spec), "k")  # one row per wanted quantile
    start = F.col("below") + F.col("before")
    held = lambda r: (F.col(r) >= start) & (F.col(r) < start + F.col("count"))
    rows = at.groupBy("want").agg(
        F.max(F.when(held("f"), F.col("v"))).alias("low"),
        F.max(F.when(held("c"), F.col("v"))).alias("high"),
    ).collect()
    for row in rows:
        want = wants[row["want"]]
        want["value"] = row["low"] + (row["high"] - row["low"]) * (want["h"] - want["f"])


def join_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Join ``groups`` (one row each, computed before). While they are few they go to the rows: dealt by group,
    a group with a third of the rows would be sorted by one task."""
    few = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return rows.join(F.broadcast(groups) if few else groups, by)


def _bracket_names(probs) -> list[tuple[str, str]]:
    return [(f"_lo{i}", f"_hi{i}") for i in range(len(probs))]


def group_brackets(values: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """by, _n and for each quantile a bracket (_lo, _hi) that holds its two neighbouring ranks.

    ``values`` has by and _v (not null). A sketch per group gives the first brackets. Where a group is so large
    that its brackets hold more than BRACKET_ROWS rows, they are counted exactly and narrowed by a finer sketch of
    the rows inside, round by round; only the groups that are still wide take part. Groups, not rows, are joined.
    """
    names, margin = _bracket_names(probs), 5.0 / SKETCH
    points = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    first = values.groupBy(*by).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", points, SKETCH).alias("_e"))
    small = F.col("_n") <= SKETCH  # where a rank is more than the sketch's margin
    out = first.select(*by, "_n", *[
        c for i, (p, (lo, hi)) in enumerate(zip(probs, names)) for c in (
            F.when(small | F.lit(p <= margin), F.col("_min")).otherwise(F.col("_e")[2 * i]).alias(lo),
            F.when(small | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.col("_e")[2 * i + 1]).alias(hi))])
    out = cut_lineage(out)
    # a bracket of the sketch holds this share of its group at most
    held = F.when(F.col("_n") <= SKETCH, F.col("_n")).otherwise(F.col("_n") * F.lit(4 * margin))
    wide, settled = out.where(held > BRACKET_ROWS), out.where(held <= BRACKET_ROWS)
    while not wide.isEmpty():
        narrowed = cut_lineage(_narrowed(values, wide, probs, by))
        moved = F.lit(False)
        for lo, hi in names:
            moved = moved | F.col(f"_moved{lo}")
        done = ~(F.col("_wide") & moved)
        settled = settled.unionByName(narrowed.where(done).select(*out.columns))
        wide = narrowed.where(~done).select(*out.columns)
    return settled


def _narrowed(values: DataFrame, wide: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """The brackets of wide groups after one counting round; _wide: some still held too many rows before it."""
    names, steps = _bracket_names(probs), [k / GRID for k in range(GRID + 1)]
    rows = join_groups(values, wide, by)
    inside = [F.col("_v").between(F.col(lo), F.col(hi)) for lo, hi in names]
    counted = rows.groupBy(*by).agg(
        F.first("_n").alias("_n"),
        *[a for i, (lo, hi) in enumerate(names) for a in (
            F.first(lo).alias(lo), F.first(hi).alias(hi),
            F.count_if(F.col("_v") < F.col(lo)).alias(f"_b{i}"), F.count_if(inside[i]).alias(f"_m{i}"),
            F.percentile_approx(F.when(inside[i], F.col("_v")), steps, SKETCH).alias(f"_g{i}"))])
    still, columns = F.lit(False), []
    for i, (p, (lo, hi)) in enumerate(zip(probs, names)):
        h = (F.col("_n") - 1) * F.lit(float(p))
        full = (F.col(f"_m{i}") > BRACKET_ROWS) & (F.col(lo) < F.col(hi))
        at = lambda rank, i=i: GRID * (rank - F.col(f"_b{i}")) / F.col(f"_m{i}")
        slack = 1 + F.ceil(2 * GRID / F.col(f"_m{i}"))  # more than the sketch's error, and two rows at least
        low = F.greatest(F.lit(0), F.floor(at(F.floor(h))) - slack).cast("int")
        high = F.least(F.lit(GRID), F.ceil(at(F.ceil(h) + 1)) + slack).cast("int")
        new_lo = F.when(full & (low > 0), F.get(f"_g{i}", low)).otherwise(F.col(lo))
        new_hi = F.when(full & (high < GRID), F.get(f"_g{i}", high)).otherwise(F.col(hi))
        still = still | full
        columns += [new_lo.alias(lo), new_hi.alias(hi), ((new_lo > F.col(lo)) | (new_hi < F.col(hi))).alias(f"_moved{lo}")]
    return counted.select(*by, "_n", *columns, still.alias("_wide"))


def grouped_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: list[str]
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name in ``probs``.

    Brackets (``group_brackets``) hold few rows each. Rows below one collapse to a count on the map side, rows
    above it are dropped, and only the bracket's rows are sorted, each bracket of each group by itself: a group
    that holds a third of the table is split like any other.
    """
    v = df.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    points = list(probs.values())
    x = join_groups(v, group_brackets(v, points, by), by)
    seen = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.when(F.col("_v") >= F.col(lo), F.col("_v")).alias("_k"), (F.col("_v") <= F.col(hi)).alias("_in"))
        for i, (lo, hi) in enumerate(_bracket_names(points))])
    counts = (
        x.select(*by, "_n", F.inline(F.filter(seen, lambda s: s["_in"])))
        .groupBy(*by, "_n", "_i", "_k").agg(F.count("*").alias("_c"))
    )
    w = W.partitionBy(*by, "_i").orderBy(F.col("_k").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    at = counts.withColumn("_s", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        h = (F.col("_n") - 1) * F.lit(float(p))
        for label, rank in (("f", F.floor(h)), ("c", F.ceil(h))):
            held = (F.col("_i") == i) & F.col("_k").isNotNull() & (rank >= F.col("_s")) & (rank < F.col("_s") + F.col("_c"))
            aggs.append(F.max(F.when(held, F.col("_k"))).alias(f"_{label}_{name}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_w_{name}"))
    outside = F.raise_error(F.lit("quantile fell outside its bracket")).cast("double")
    found = lambda c: F.coalesce(F.col(c), outside)
    return at.groupBy(*by).agg(*aggs).select(
        *by, *[_interpolate(found(f"_f_{n}"), found(f"_c_{n}"), F.col(f"_w_{n}")).alias(n) for n in probs])
