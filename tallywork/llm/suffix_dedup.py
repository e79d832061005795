"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Sparse suffix arrays: a window of ``length`` bytes is represented by one of its k-grams, the one with the
smallest hash, so equal windows choose equal k-grams. Consecutive windows share their choice; such a run,
about 1 in 14 positions, is one entry: hash of the k-gram, hash of all bytes of the run's windows, document
and place. Every task deals out batches of entries by key range; for every key range the batches enter an index
family one by one: a batch is sorted by k-gram, as a suffix array is sorted by content, and merge-scanned against
each level there is for equal k-grams; what matches is marked on both sides. Then it becomes a level itself, and
levels of equal size are merged, so sizes grow geometrically and an entry moves a logarithmic number of times.

Equal runs are settled there: all windows of the run in the later document go. K-grams that documents share
in different runs, at the edges of passages, are settled by the windows themselves: for those only, the
documents are fetched, and their windows go through an index family of the same kind.

A passage that very many documents share is settled inside each batch first: of equal entries only the one
of the smallest id is dealt out, so a key never gathers more than one entry from a batch.

Texts that a document with a smaller id holds as a whole go completely; a task passes over those that it remembers.
Rows are sorted by key range (and by bucket of documents), and a task holds one range, bucket or document at a time.

A document is named by its id and a tag: zero, or, where different texts may have the id (null ids are one id),
the 64-bit hash of its text. Which ids those are is told by cells, so some others have a hash for a tag too.

Defined results: a null text is empty; texts shorter than ``length`` bytes stay; rows with equal ids are
not earlier than each other; a null id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tallywork.llm.common import cells_of, mixed, only_cells, release, take, trim
from tallywork.session import cut_lineage

BASE = 0x2545F4914F6CDD1D
GRAM = 24
# Windows that are worked on at once; bytes of text behind one key range.
BLOCK, RANGE_BYTES = 1 << 20, 32 << 20
NO_ID = (1 << 63) - 1
# Entries of one batch as it is dealt out, and as it enters a family; columns of an entry with their types and widths (of a k-gram's hash 48 bits count).
BATCH, ENTER = 1 << 18, 1 << 16
LAYOUT = {"k": ("<u8", 8), "s": ("<u4", 4), "id": ("<i8", 8), "tag": ("<i8", 8), "at": ("<u4", 4)}
# Columns of a place found; whole: all windows of its run go.
FOUND = {"id": ("<i8", 8), "tag": ("<i8", 8), "at": ("<u4", 4), "whole": ("u1", 1)}
ENTRIES = "shard int, entries binary, id long, tag long, full array<int>"
# Cells of ids, to tell which ids several texts may have; texts that a task remembers to pass over their copies.
ID_CELLS, KNOWN = 1 << 18, 1 << 16


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(n, base, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Runs:
    """Cuts a text into runs of windows that choose the same k-gram."""

    def __init__(self, length: int):
        self.length, self.wide = length, length - GRAM + 1
        self.forth = self.back = np.zeros(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.forth) <= len(data):
            self.forth, self.back = powers(min(BLOCK + self.length, 2 * len(data)) + 1)
        return np.concatenate(([np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.forth[: len(data)])))

    def blocks(self, raw: bytes):
        """Offset and bytes of overlapping stretches; every window lies in one of them."""
        for start in range(0, max(0, len(raw) - self.length + 1), BLOCK):
            yield start, np.frombuffer(raw, np.uint8, min(BLOCK + self.length - 1, len(raw) - start), start)

    def cut(self, raw: bytes):
        """Per run: hash of the k-gram, hash of the run, first and last window."""
        found = [self._cut(start, data) for start, data in self.blocks(raw)]
        if not found:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _cut(self, start: int, data: np.ndarray):
        sums = self.sums(data)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * self.back[: len(sums) - GRAM])
        place = np.uint64((1 << 24) - 1)
        order = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        # smallest of each `wide` neighbours, by doubling
        least, held = order, 1
        while held < self.wide:
            step = min(held, self.wide - held)
            least = np.minimum(least[: len(least) - step], least[step:])
            held += step
        chosen = (least & place).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(chosen) - 1]))
        gram = chosen[first]
        run = (sums[last + self.length] - sums[first]) * self.back[first]
        run = mixed(run ^ mixed(((last - first) * 64 + gram - first).astype(np.uint64)))
        return grams[gram] & ~np.uint64(0xFFFF), (run >> np.uint64(32)).astype(np.uint32), first + start, last + start

    def windows(self, raw: bytes, first: np.ndarray, last: np.ndarray):
        """Hash and start of every window of the given runs."""
        hashes, places = [], []
        for start, data in self.blocks(raw):
            own = (first >= start) & (first < start + BLOCK)
            a, n = first[own] - start, last[own] - first[own] + 1
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            sums = self.sums(data)
            hashes.append(mixed((sums[at + self.length] - sums[at]) * self.back[at]))
            places.append(at + start)
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *places])


def pack(columns: dict[str, np.ndarray], layout=LAYOUT) -> bytes:
    """Columns byte plane by byte plane, so that the shuffle's compression finds what repeats."""
    return b"".join(
        np.ascontiguousarray(columns[c].astype(t)).view(np.uint8).reshape(-1, wide).T.tobytes() for c, (t, wide) in layout.items())


def unpack(data: bytes, layout=LAYOUT) -> dict[str, np.ndarray]:
    n = len(data) // sum(wide for _, wide in layout.values())
    out, at = {}, 0
    for c, (t, wide) in layout.items():
        planes = np.frombuffer(data, np.uint8, n * wide, at).reshape(wide, n)
        out[c] = np.ascontiguousarray(planes.T).view(t).reshape(-1)
        at += n * wide
    return out


def spread(ids: np.ndarray, tags: np.ndarray, bits: int) -> np.ndarray:
    """A number of so many bits for each document."""
    hashes = mixed(ids.astype(np.uint64) ^ mixed(tags.astype(np.uint64)))
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ids), np.int64)


def by_document(ids, tags, *lists) -> list[pa.Array]:
    """Arrow columns id, tag and lists of places; each of ``lists`` is a mask and the places, in order of documents."""
    new = np.flatnonzero(np.concatenate(([True], (np.diff(ids) != 0) | (np.diff(tags) != 0)))) if len(ids) else np.zeros(0, np.int64)
    out = [pa.array(ids[new], pa.int64()), pa.array(tags[new], pa.int64())]
    for mask, places in lists:
        ends = np.concatenate(([0], np.cumsum(mask)))
        offsets = np.concatenate((ends[new], ends[-1:])).astype(np.int32)
        out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[mask].astype(np.int32))))
    return out


def deal(parts: list[dict[str, np.ndarray]], bits: int):
    """A batch of entries in order of documents: rows for the key ranges, and what the batch itself settles.

    Of entries with equal hashes only those of the smallest id are dealt out; the others are settled.
    """
    columns = {c: np.concatenate([p[c] for p in parts]) for c in LAYOUT}
    name = columns["k"] ^ mixed(columns["s"].astype(np.uint64))
    order = np.argsort(name)
    new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
    least = np.minimum.reduceat(columns["id"][order], np.flatnonzero(new))[np.cumsum(new) - 1]
    settled = np.empty(len(name), bool)
    settled[order] = columns["id"][order] > least
    rest = {c: v[~settled] for c, v in columns.items()}
    # a chosen k-gram has the smallest of many hashes, so these crowd near zero: mixed once more, ranges are even
    shard = (mixed(rest["k"]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rest["k"]), np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(shard)]))
    rows = [(int(shard[order[a]]), pack({c: v[order[a:b]] for c, v in rest.items()})) for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    n = len(rows)
    nothing = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()))]
    names = ["shard", "entries", "id", "tag", "full"]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *nothing], names=names)
    own = by_document(columns["id"][settled], columns["tag"][settled], (np.ones(int(settled.sum()), bool), columns["at"][settled]))
    n = len(own[0])  # these only pass through; any key range will do
    anywhere = pa.array(spread(own[0].to_numpy(), own[1].to_numpy(), bits), pa.int32())
    yield pa.RecordBatch.from_arrays([anywhere, pa.nulls(n, pa.binary()), *own], names=names)


def dealt(documents, bits: int):
    """``documents`` yields the entries of one document after the other; they are dealt out in batches."""
    parts, held = [], 0
    for own in documents:
        parts.append(own)
        held += len(own["k"])
        if held >= BATCH:
            yield from deal(parts, bits)
            parts, held = [], 0
    if held:
        yield from deal(parts, bits)


def rows_of(batches, *columns):
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            yield from zip(*(piece.column(c).to_pylist() for c in columns))
        trim()


def _runs(length: int, bits: int):
    def run(batches):
        runs, known = Runs(length), {}

        def documents():
            for id_, tag, text in rows_of(batches, "id", "tag", "text"):
                raw = text.encode("utf-8", "replace")
                name = hashlib.md5(raw).digest()
                if len(raw) < length or known.get(name, NO_ID + 1) <= id_:
                    continue  # an earlier document of this task holds the same text
                if len(known) >= KNOWN:
                    known.clear()  # later copies are indexed like any text
                known[name] = id_
                k, s, _, _ = runs.cut(raw)
                n = len(k)
                yield {
                    "k": k, "s": s, "id": np.full(n, id_, np.int64), "tag": np.full(n, tag, np.int64),
                    "at": np.arange(n, dtype=np.uint32)}

        yield from dealt(documents(), bits)

    return run


class Level(dict):
    """Entries sorted by k-gram, column by column, with what the scans have found out about each."""

    @classmethod
    def of(cls, columns: dict[str, np.ndarray]) -> Level:
        order = np.argsort(columns["k"], kind="stable")
        own = cls({c: v[order] for c, v in columns.items()})
        own["full"], own["edge"] = np.zeros(len(order), bool), np.zeros(len(order), bool)
        return own

    def __len__(self):
        return len(self["k"])

    def merged(self, other: Level) -> Level:
        order = np.argsort(np.concatenate((self["k"], other["k"])), kind="stable")  # it recognises the two runs
        return Level({c: np.concatenate((self.pop(c), other.pop(c)))[order] for c in list(self)})


def compare(*sides: tuple[Level, np.ndarray]) -> None:
    """Mark, among the given rows of levels, entries whose run an earlier document has (full), and those whose
    k-gram another document has in another run (edge)."""
    if not sum(len(rows) for _, rows in sides):
        return
    k, s, ids = (np.concatenate([level[c][rows] for level, rows in sides]) for c in ("k", "s", "id"))
    order = np.lexsort((ids, s, k))
    k, s, ids = k[order], s[order], ids[order]
    new_k = np.concatenate(([True], k[1:] != k[:-1]))
    new_run = new_k | np.concatenate(([True], s[1:] != s[:-1]))
    gram_at, run_at = np.flatnonzero(new_k), np.flatnonzero(new_run)
    gram_no, run_no = np.cumsum(new_k) - 1, np.cumsum(new_run) - 1
    several_docs = (np.maximum.reduceat(ids, gram_at) != np.minimum.reduceat(ids, gram_at))[gram_no]
    several_runs = (np.add.reduceat(new_run.astype(np.int64), gram_at) > 1)[gram_no]
    full, edge = np.empty(len(k), bool), np.empty(len(k), bool)
    full[order], edge[order] = ids > ids[run_at][run_no], several_docs & several_runs
    start = 0
    for level, rows in sides:
        level["full"][rows] |= full[start : start + len(rows)]
        level["edge"][rows] |= edge[start : start + len(rows)]
        start += len(rows)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Rows of a sorted array whose key occurs more than once."""
    same = np.concatenate(([False], keys[1:] == keys[:-1], [False])) if len(keys) else np.zeros(1, bool)
    return np.flatnonzero(same[1:] | same[:-1])


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two sorted arrays whose keys occur in both; ``a`` is looked up in ``b``."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.flatnonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    keys = np.unique(a[rows])
    first, n = np.searchsorted(b, keys), np.searchsorted(b, keys, "right")
    n -= first
    return rows, np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class IndexFamily:
    """Levels whose sizes fall geometrically. An array that enters is scanned against each level before it becomes
    one itself, so any two entries with equal k-grams are compared when the later of them enters."""

    def __init__(self):
        self.levels: list[Level] = []

    def enter(self, columns: dict[str, np.ndarray]) -> None:
        own = Level.of(columns)
        rows = repeated(own["k"])
        compare((own, rows))
        for level in self.levels:
            mine, others = common(own["k"], level["k"])
            compare((own, mine), (level, others))
        while self.levels and len(self.levels[-1]) <= 2 * len(own):
            own = self.levels.pop().merged(own)
        self.levels.append(own)

    def found(self) -> dict[str, np.ndarray]:
        """Places whose runs go as a whole, and those to be settled window by window."""
        marked = [(level, np.flatnonzero(level["full"] | level["edge"])) for level in self.levels]
        out = {c: np.concatenate([level[c][rows] for level, rows in marked]) for c in ("id", "tag", "at")}
        return {**out, "whole": np.concatenate([level["full"][rows] for level, rows in marked])}


def bundles(places: dict[str, np.ndarray], bits: int) -> pa.RecordBatch:
    """Places found, one row for each of the buckets of documents: what a document has in many key ranges is no row each."""
    bucket = spread(places["id"], places["tag"], bits)
    order = np.argsort(bucket, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(bucket)]))
    spans = [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if b > a]
    return pa.RecordBatch.from_arrays([
        pa.array([int(bucket[order[a]]) for a, _ in spans], pa.int32()),
        pa.array([pack({c: places[c][order[a:b]] for c in FOUND}, FOUND) for a, b in spans], pa.binary())],
        names=["bucket", "places"])


def groups_of(batches, key: str, value: str):
    """Rows sorted by ``key``: each key with an iterator over its values, one key at a time in memory."""
    def rows():
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                yield from zip(piece.column(key).to_pylist(), piece.column(value))

    for k, own in itertools.groupby(rows(), key=lambda row: row[0]):
        yield k, (data.as_py() for _, data in own)


def _index(bits: int):
    """The key ranges of one partition, sorted by range: one index family at a time."""

    def run(batches):
        passed = []

        def entries():
            for batch in batches:
                settled = batch.filter(batch.column("entries").is_null())
                if settled.num_rows:
                    n = settled.column("full").value_lengths().to_numpy(zero_copy_only=False)
                    places = {c: np.repeat(settled.column(c).to_numpy(zero_copy_only=False), n) for c in ("id", "tag")}
                    places["at"] = settled.column("full").flatten().to_numpy(zero_copy_only=False)
                    passed.append(bundles({**places, "whole": np.ones(len(places["at"]), bool)}, bits))
                yield batch.filter(batch.column("entries").is_valid())

        for _, blobs in groups_of(entries(), "shard", "entries"):
            family, waiting, held = IndexFamily(), [], 0
            for data in itertools.chain(blobs, [None]):
                if data:
                    waiting.append(unpack(data))
                    held += len(waiting[-1]["k"])
                if waiting and (held >= ENTER or not data):
                    family.enter({c: np.concatenate([w[c] for w in waiting]) for c in LAYOUT})
                    waiting, held = [], 0
                while passed:
                    yield passed.pop()
            found = family.found()
            del family
            yield bundles(found, bits)
            trim()
        yield from passed

    return run


def _gather(batches):
    """The places of each document, a bucket at a time; ``batches`` are sorted by bucket."""
    for _, blobs in groups_of(batches, "bucket", "places"):
        parts = [unpack(data, FOUND) for data in blobs]
        places = {c: np.concatenate([p[c] for p in parts]) for c in FOUND}
        del parts
        order = np.lexsort((places["tag"], places["id"]))
        ids, tags, at, whole = (places.pop(c)[order] for c in FOUND)
        whole = whole.astype(bool)
        out = pa.RecordBatch.from_arrays(by_document(ids, tags, (whole, at), (~whole, at)), names=["id", "tag", "full", "edge"])
        for start in range(0, out.num_rows, 4096):
            yield out.slice(start, 4096)
        trim()


def _squeeze(batches):
    """Texts as Zstandard frames: they cross a shuffle smaller than its own compression makes them."""
    frames = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            piece = batch.slice(start, 256)
            raw = piece.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([frames.compress(r) for r in raw], pa.binary()), piece.column("key")], names=["packed", "key"])
        trim()


def _edges(length: int, bits: int):
    def run(batches):
        runs = Runs(length)

        def documents():
            for id_, tag, packed, edge in rows_of(batches, "id", "tag", "packed", "edge"):
                raw = zstandard.decompress(packed)
                _, _, first, last = runs.cut(raw)
                wanted = np.sort(np.array(edge, np.int64))
                k, at = runs.windows(raw, first[wanted], last[wanted])
                n = len(k)
                yield {
                    "k": k, "s": np.zeros(n, np.uint32), "id": np.full(n, id_, np.int64), "tag": np.full(n, tag, np.int64),
                    "at": at.astype(np.uint32)}

        yield from dealt(documents(), bits)

    return run


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes lie in [first, last)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0


def _removal(length: int, texts: bool):
    def run(batches):
        runs, rows, held = Runs(length), [], 0

        def out():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["_id", "_tag", "removed", "spans", "left", "sha"])

        for id_, tag, packed, full, single in rows_of(batches, "id", "tag", "packed", "full", "single"):
            raw = zstandard.decompress(packed)
            _, _, first, last = runs.cut(raw)
            whole, one = np.array(full or [], np.int64), np.array(single or [], np.int64)
            gone = covered(len(raw), np.concatenate((first[whole], one)), np.concatenate((last[whole], one)) + length)
            spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((id_, tag, int(gone.sum()), spans, kept.decode("utf-8", "ignore") if texts else None, hashlib.sha256(kept).hexdigest()))
            held += len(kept)
            if held > 4 << 20:
                yield out()
                rows, held = [], 0
        if rows:
            yield out()

    return run


def family(entries: DataFrame, bits: int) -> DataFrame:
    """Entries dealt out by their batches -> id, tag, full, edge: the places found, by document."""
    wide = min(bits, 14)
    ranges = entries.repartition(1 << wide, "shard").sortWithinPartitions("shard")
    found = ranges.mapInArrow(_index(bits), "bucket int, places binary")
    buckets = found.repartition(1 << wide, "bucket").sortWithinPartitions("bucket")
    return buckets.mapInArrow(_gather, "id long, tag long, full array<int>, edge array<int>")


def key_bits(total: int, each: int) -> int:
    """Key ranges, as a power of two, of about ``each`` of ``total``; some more, so that small jobs spread too."""
    return max(0, math.ceil(math.log2(max(1, total / each)))) + (2 if 32 * total > each else 0)


def dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, texts: bool = False,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with ``texts`` also what is left.

    (Where a cut falls inside a character, the texts leave out its remaining bytes; the hash covers them.)
    """
    spark, body = df.sparkSession, F.coalesce("text", F.lit(""))
    docs = take(df, doc_id=doc_id, text=text).select("doc_id", body.alias("text"))
    docs = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = cut_lineage(docs.select(
        "doc_id", "id", F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.md5("text")).alias("md5"),
        F.unhex(F.sha2("text", 256)).alias("whole")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    several = rows.groupBy("id").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b")
    cells = cut_lineage(several.select(cells_of("id", ID_CELLS).alias("_cell")).distinct())

    def tagged(frame: DataFrame, text_hash) -> DataFrame:
        marked = frame.join(F.broadcast(cells), cells_of("id", ID_CELLS) == F.col("_cell"), "left")
        tag = F.when(F.col("_cell").isNotNull(), text_hash).otherwise(F.lit(0).cast("long"))
        return marked.withColumn("tag", tag).drop("_cell")

    docs, rows = tagged(docs, F.xxhash64("text")), tagged(rows, F.col("hash")).drop("hash")
    # documents that a smaller id holds as a whole need no cutting
    firsts = rows.groupBy("md5").agg(F.min("id").alias("first_id")).withColumnRenamed("md5", "_md5")
    rows = rows.join(firsts, F.col("md5") == F.col("_md5")).withColumn("copy", F.col("id") > F.col("first_id"))
    rows = cut_lineage(rows.drop("_md5", "md5", "first_id"))
    own = rows.where("not copy").select("id", "tag").distinct()
    key = F.xxhash64("id", "tag").alias("key")
    keyed = docs.select("text", key)

    def fetched(wanted: DataFrame) -> DataFrame:
        """The texts of the documents wanted; others are dropped before the join moves them."""
        return only_cells(keyed, "key", wanted).mapInArrow(_squeeze, "packed binary, key long").join(wanted, "key")

    def shared_runs() -> DataFrame:
        bits = key_bits(total, RANGE_BYTES)
        entries = docs.select("id", "tag", "text").mapInArrow(_runs(length, bits), ENTRIES)
        found = family(entries, bits).join(own, ["id", "tag"])
        return cut_lineage(found.select(key, "id", "tag", "full", "edge"))

    def edge_windows(found: DataFrame) -> DataFrame:
        edges = found.where(F.size("edge") > 0).select("key", "id", "tag", "edge")
        runs = edges.agg(F.sum(F.size("edge"))).first()[0] or 0
        bits = key_bits(16 * runs, RANGE_BYTES // 14)
        bodies = fetched(edges).select("id", "tag", "packed", "edge")
        entries = bodies.mapInArrow(_edges(length, bits), ENTRIES)
        return cut_lineage(family(entries, bits).select("id", "tag", F.col("full").alias("single")))

    found = shared_runs()
    release(spark)
    single = edge_windows(found)
    release(spark)
    cuts = found.where(F.size("full") > 0).select("id", "tag", "full").join(single, ["id", "tag"], "full")
    cuts = cut_lineage(cuts.select(key, "id", "tag", "full", "single"))
    removed = fetched(cuts).select("id", "tag", "packed", "full", "single").mapInArrow(
        _removal(length, texts), "_id long, _tag long, removed long, spans long, left string, sha string")
    if not texts:
        removed = removed.drop("left")
    removed = removed.dropDuplicates(["_id", "_tag"])
    out = rows.join(removed, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left")
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    of = lambda copied, other, none: F.when(gone, copied).when(F.col("copy"), none).otherwise(F.coalesce(other, none))
    empty = hashlib.sha256(b"").hexdigest()
    columns = [
        "doc_id", "n_bytes", of(F.col("n_bytes"), F.col("removed"), F.lit(0).cast("long")).alias("n_removed"),
        of(F.lit(1).cast("long"), F.col("spans"), F.lit(0).cast("long")).alias("n_spans"),
        of(F.lit(empty), F.col("sha"), F.lower(F.hex("whole"))).alias("kept_sha256")]
    if texts:  # where nothing was cut the text is the document's own: null here
        columns.append(of(F.lit(""), F.col("left"), F.lit(None).cast("string")).alias("text_left"))
    return out.select(*columns)
