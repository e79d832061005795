"""Benchmark decontamination: one automaton over all test windows, each text scanned once.

Texts are normalised byte by byte (ASCII letters to lower case, every other ASCII byte that is no digit
to a blank), and an Aho-Corasick automaton over the windows of the test items finds every occurrence in
one scan. Words are written as two symbols, so that a window has 26 of them however long its words are;
positions lead back to word numbers and, for callers that cut passages out, to character offsets of the original.

The test items are the stated query set. They come to the driver in blocks whose automaton takes about
``block_bytes`` in a worker; a long item may lie in several. Each block is one scan, and its hits are written
before the next is built, so that driver and workers hold one block at a time, however many items there are.

Defined results: null texts and texts without words have no hits; an item without words is never found;
items with null ids are found but listed as an empty string; items that repeat an id count once; an empty table
of documents gives an empty result, one of items no hits; texts are scanned whole, however long.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import take, trim, written

WINDOW = 13
# Byte by byte: A-Z to a-z, digits, a-z and bytes of non-ASCII characters as they are, the rest to blanks.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(rb"[^ ]+")
# The symbols of a word are of two kinds, so that no window is found between words; no item has the unknown word.
UNKNOWN = "\0\0"
STATE_BYTES, WINDOW_BYTES = 50, 350  # a symbol in the automaton; a window in the dictionary (measured)


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(NORMAL).split(b" ") if text else []


def symbols(number: int) -> str:
    """Two characters for a word; few different first ones, because a state looks through its followers in turn."""
    return chr(1 + number % 255) + chr(256 + number // 255)


class Block:
    """Windows of some items: their words' symbols, and the items that hold each window."""

    def __init__(self):
        self.words: dict[bytes, str] = {}
        self.items: dict[str, tuple[str, ...]] = {}
        self.bytes = 0

    def add(self, window: list[bytes], item: str) -> None:
        for w in window:
            if w not in self.words:
                self.words[w] = symbols(len(self.words))
        key = "".join([self.words[w] for w in window])
        held = self.items.get(key, ())
        if item not in held:
            self.items[key] = (*held, item)
        if not held:
            self.bytes += STATE_BYTES * len(key) + WINDOW_BYTES

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for key, items in self.items.items():
            found.add_word(key, (len(key) // 2, items))
        found.make_automaton()
        return found


def item_blocks(items: DataFrame, item_id: str, text: str, size: int, block_bytes: int):
    """Blocks of windows (``size`` words, or all words of an item that has fewer)."""
    block = Block()
    for row in take(items, item=item_id, text=text).toLocalIterator():
        words = [w for w in normal_words(row["text"]) if w]
        for i in range(max(1, len(words) - size + 1) if words else 0):
            if block.bytes >= block_bytes:
                yield block
                block = Block()
            block.add(words[i : i + size], "" if row["item"] is None else str(row["item"]))
    if block.items:
        yield block


def scan(text: str | None, words_of: dict[bytes, str], found: ahocorasick.Automaton | None):
    """Number of words, (first word, word after the last) of each occurrence, and the items met."""
    words = [w for w in normal_words(text) if w]
    if found is None or not words:
        return len(words), [], set()
    spans, ids = [], set()
    for end, (n, items) in found.iter("".join([words_of.get(w, UNKNOWN) for w in words])):
        last = (end + 1) // 2
        spans.append((last - n, last))
        ids.update(items)
    return len(words), spans, ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of characters of the original text."""
    raw = text.encode("utf-8", "replace")
    at = [(m.start(), m.end()) for m in WORD.finditer(raw.translate(NORMAL))]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters begun up to each byte
    return [(int(chars[at[a][0]]) - 1, int(chars[at[b - 1][1] - 1])) for a, b in spans]


def matcher(spark, block: Block | None):
    """A column function: text -> struct(n_words, spans of words, items); and what it holds in the workers."""
    held = spark.sparkContext.broadcast((block.words, block.items) if block else None)
    made: list = []

    def match(text: pd.Series) -> pd.DataFrame:
        if not made:
            own = Block()
            own.words, own.items = held.value or ({}, {})
            made.append((own.words, own.automaton() if own.items else None))
        n, spans, ids = [], [], []
        for t in text:
            words, at, met = scan(t, *made[0])
            n.append(words)
            spans.append([x for span in merged(at) for x in span])
            ids.append(sorted(met))
        trim()
        return pd.DataFrame({"n_words": n, "spans": spans, "items": ids})

    return F.pandas_udf(match, "n_words long, spans array<int>, items array<string>"), held


def covered_words(spans: Column) -> Column:
    """Words in the union of spans, given as one array of first words and words after the last."""
    pairs = F.when(F.size(spans) > 0, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(spans) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(spans, 2 * i).alias("a"), F.get(spans, 2 * i + 1).alias("b")))).otherwise(F.array())
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(pairs), start, lambda held, p: F.struct(
        F.greatest(held["end"], p["b"]).alias("end"),
        (held["n"] + F.greatest(F.lit(0), p["b"] - F.greatest(held["end"], p["a"]))).alias("n")), lambda held: held["n"])


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word in ``share`` is part of a test window."""
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    size: int = WINDOW, block_bytes: int = 256 << 20,
) -> DataFrame:
    """Every row of ``df`` with n_words, n_hit, n_items, items_sha256, contaminated and the word spans."""
    spark, columns = df.sparkSession, df.columns
    blocks = item_blocks(items, item_id, item_text, size, block_bytes)
    match, _ = matcher(spark, next(blocks, None))
    out = df.withColumn("_met", match(F.col(text)))
    spans, ids = F.col("_met.spans"), F.col("_met.items")
    second = next(blocks, None)
    if second is not None:
        # rows are numbered once they are written, so that a lost executor finds the same numbers again
        out = written(out.withColumn("_row", F.monotonically_increasing_id()), "scanned")
        hits = []
        for block in chain([second], blocks):
            match, held = matcher(spark, block)
            met = out.select("_row", match.asNondeterministic()(F.col(text)).alias("_more"))
            hits.append(written(met.where(F.size("_more.spans") > 0), "hits"))
            held.unpersist()
        more = reduce(DataFrame.unionByName, hits).groupBy("_row").agg(  # at most one row a block
            F.flatten(F.collect_list("_more.spans")).alias("_spans"), F.flatten(F.collect_list("_more.items")).alias("_ids"))
        out = out.join(more, "_row", "left")
        spans = F.concat(spans, F.coalesce("_spans", F.array().cast("array<int>")))
        ids = F.concat(ids, F.coalesce("_ids", F.array().cast("array<string>")))
    out = out.withColumn("_spans", spans).withColumn("_items", F.array_sort(F.array_distinct(ids)))
    out = out.withColumn("_hit", covered_words(F.col("_spans")))
    n_words, n_hit = F.col("_met.n_words"), F.col("_hit")
    return out.select(
        *columns, n_words.alias("n_words"), n_hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        contaminated(n_words, n_hit).alias("contaminated"), F.col("_spans").alias("word_spans"))
