"""Runs of repeated words: found exactly with longest common extensions, and collapsed to one period.

A run is a stretch of consecutive words with smallest period q, at least ``times`` periods and ``least`` words
long, which no neighbouring word extends. Per document:

1. Harmonic grid. For each period q only every q-th word is looked at together with the word q further on. The
   run's second period holds a grid point around which up to q words on both sides equal those q further on; a
   few of these are compared, all grid points of many periods at once, which leaves next to nothing of plain
   prose. There are n/1 + n/2 + n/3 + ... points.
2. Extensions. How far equality reaches to the right and left of a surviving pair gives the run's ends. The
   reach is a longest common extension (``Extensions``): of all suffixes only those at the positions of a
   difference cover are sorted; for any two positions some offset below v puts both on the cover, so up to v
   words are compared, and the rest is a range minimum over the sorted samples' common prefixes, from a sparse
   table. Sorting is by the first v words, then by doubling; common prefixes come from the ranks of each
   doubling. Left extensions use the same on the reversed words. A document without surviving pairs has no run,
   and nothing is sorted for it.
3. Periods are taken in rising order. Pairs inside a run already found, of a period that divides theirs, would
   find that run again and are left out; equal stretches found under several periods keep the smallest one.

A word goes if a run contains it after that run's first period. Documents are independent: nothing is shuffled,
a task holds 4 MB of texts or one document, and its arrays are a small multiple of that document.

Defined results: null and empty texts have no words and no runs, and collapse to the empty text; every row gets
its own result, so repeated rows and null ids are rows like others; very long texts are handled whole (the
cover grows, so that samples get rarer); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallywork.llm.common import slices, take, trim

# Grid points looked at together; words compared to either side of one; words from which covers are larger.
POINTS, PROBES, LARGER = 1 << 16, 4, (1 << 12, 1 << 20)


@lru_cache(maxsize=None)
def cover(r: int) -> tuple[int, np.ndarray, np.ndarray]:
    """v, a difference cover modulo v, and for each pair of remainders the least offset that puts both on it.

    Gaps by Colbourn and Ling's rule: 6 r + 4 positions for v = 24 r^2 + 36 r + 13.
    """
    gaps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    v = 24 * r * r + 36 * r + 13
    held = np.zeros(2 * v, bool)
    held[np.cumsum([0] + gaps)] = True
    held[v:] = held[:v]
    offsets = np.full((v, v), -1, np.int16)
    for d in range(v - 1, -1, -1):
        own = held[d : d + v]
        offsets[np.logical_and.outer(own, own)] = d
    return v, held[:v], offsets


def packed(padded: np.ndarray, at: np.ndarray, v: int, top: int) -> list[np.ndarray]:
    """The ``v`` words from each position as a few numbers, to be compared one after the other."""
    bits = max(1, int(top).bit_length())
    each, out = max(1, 63 // bits), []
    for start in range(0, v, each):
        key = np.zeros(len(at), np.int64)
        for i in range(start, min(v, start + each)):
            key = (key << bits) | padded[at + i]
        out.append(key)
    return out


def dense(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1; equal keys share one."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new) + 1
    return ranks


class Extensions:
    """How many words from two positions on are equal, for many pairs at once."""

    def __init__(self, words: np.ndarray):
        """``words`` are numbers from 1; equal words have equal numbers."""
        n = self.n = len(words)
        self.v, held, self.offsets = cover(sum(n > x for x in LARGER))
        v = self.v
        self.words = np.concatenate((words.astype(np.int64), np.zeros(2 * v, np.int64)))
        samples = np.flatnonzero(np.tile(held, n // v + 1)[:n])
        index = np.full(n + 1, -1, np.int64)
        index[samples] = np.arange(len(samples))
        levels, wide = [dense(packed(self.words, samples, v, int(words.max())))], v
        while levels[-1].max() < len(samples):
            after = samples + wide
            inside = after < n
            second = np.zeros(len(samples), np.int64)
            second[inside] = levels[-1][index[after[inside]]]
            levels.append(dense([levels[-1], second]))
            wide *= 2
        order = np.argsort(levels[-1])
        a, b = samples[order[:-1]], samples[order[1:]]
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            x, y = a + common, b + common
            inside = np.flatnonzero((x < n) & (y < n))
            same = inside[levels[level][index[x[inside]]] == levels[level][index[y[inside]]]]
            common[same] += v << level
        common = self._compare(a, b, common, np.full(len(a), v))
        self.index, self.rank = index, levels[-1] - 1
        self.least = [common.astype(np.int32)]  # least[k][t]: the smallest of 2 ** k neighbours from t on
        while len(self.least[-1]) > 1 << (len(self.least) - 1):
            held_, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(held_[:-step], held_[step:]))

    def _compare(self, i, j, start, most):
        """``start`` more by as many words as follow there and are equal, ``most`` at most."""
        out, open_ = start.copy(), np.flatnonzero(most > 0)
        done = np.zeros(len(i), np.int64)
        while len(open_):
            same = self.words[i[open_] + out[open_]] == self.words[j[open_] + out[open_]]
            open_ = open_[same]
            out[open_] += 1
            done[open_] += 1
            open_ = open_[done[open_] < most[open_]]
        return out

    def reach(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and from ``j`` on, where i < j <= n."""
        most = self.offsets[i % self.v, j % self.v].astype(np.int64)
        out = self._compare(i, j, np.zeros(len(i), np.int64), most)
        far = np.flatnonzero((out == most) & (j + out < self.n))
        a = self.rank[self.index[i[far] + out[far]]]
        b = self.rank[self.index[j[far] + out[far]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1  # floor of the logarithm
        for k in np.unique(level):
            own = level == k
            table = self.least[k]
            out[far[own]] += np.minimum(table[low[own]], table[high[own] - (1 << int(k))])
        return out


def grid(words: np.ndarray, times: int):
    """Pairs (i, q) of the harmonic grid whose surroundings have period q as far as a few words show."""
    n = len(words)
    first = 1
    while first <= n // times:
        periods = np.arange(first, min(n // times, first + max(1, POINTS * first // n)) + 1)
        first = int(periods[-1]) + 1
        counts = n // periods - 2
        q = np.repeat(periods, counts)
        i = q * (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
        for t in sorted(range(-PROBES, PROBES), key=abs):
            if t:
                same = (t >= q) | (t < -q)
                check = np.flatnonzero(~same)
                same[check] = words[i[check] + t] == words[i[check] + q[check] + t]
            else:
                same = words[i] == words[i + q]
            i, q = i[same], q[same]
        if len(i):
            yield i, q


def runs_of(words: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and period of every run, by start and period; ``words`` are numbers from 1, ``times`` 4 or more."""
    n, found = len(words), np.zeros((3, 0), np.int64)
    forth = back = None
    for i, q in grid(words, times):
        if forth is None:
            forth, back = Extensions(words), Extensions(words[::-1])
        if found.shape[1]:
            at = np.searchsorted(found[0], i, "right") - 1
            new = (at < 0) | (i + q >= found[0, at] + found[1, at]) | (q % found[2, at] != 0)
            i, q = i[new], q[new]
        left = back.reach(n - i - q, n - i)
        right = forth.reach(i, i + q)
        start, length = i - left, left + q + right
        own = length >= np.maximum(least, times * q)
        found = np.concatenate((found, np.stack((start[own], length[own], q[own]))), axis=1)
        found = found[:, np.lexsort((found[2], found[1], found[0]))]
        new = np.ones(found.shape[1], bool)
        new[1:] = (np.diff(found[0]) != 0) | (np.diff(found[1]) != 0)
        found = found[:, new]
    start, length, q = found[:, np.lexsort((found[2], found[0]))]
    return start, length, q


def kept_words(n: int, start: np.ndarray, length: np.ndarray, q: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start + q, 1)
    np.add.at(step, start + length, -1)
    return np.cumsum(step[:-1]) == 0


def _collapse(least: int, times: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            sizes, runs, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8", "replace").split()  # bytes split at ASCII blanks only
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words), np.int64, len(words))
                own = runs_of(ids, least, times)
                sizes.append(len(words))
                runs.append(own)
                if len(own[0]):
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), *own)).tolist()]
                texts.append(b" ".join(words))
            ends = np.cumsum([0] + [len(r[0]) for r in runs]).astype(np.int32)
            columns = [pa.array(np.concatenate([r[i] for r in runs]), pa.int64()) for i in range(3)]
            found = pa.StructArray.from_arrays(columns, names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), found),
                pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
        trim()

    return run


def collapse(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the collapsed text of every row."""
    docs = take(df, doc_id=doc_id, text=text)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        _collapse(least, times),
        f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
