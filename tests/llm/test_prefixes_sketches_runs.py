"""Prefix trie, odd sketches and periodic runs against brute force, with the edge cases of their docstrings."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tallywork.llm import odd_sketch, periodic_runs, prefix_trie, queries
from test_operators import EMPTY, WORDS, corpus, prose, sets_of

WORD = r"[^\x20\x09-\x0D]+"
TURNS = "conv_id long, turn long, role string, text string, ROLE string, depth long"


# --- prefix trie ------------------------------------------------------------------------------------------


def brute_trie(rows, rebuilt=True):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuilt else 0
        paths[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, below = collections.defaultdict(list), collections.defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                below[tuple(path[: d - 1])].add(tuple(path[:d]))
    leaves, saved, out = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in below[node]) or 1
        spared = (len(members[node]) - 1) * len(re.findall(WORD, node[-1][1])) if node else 0
        saved[node] = spared + sum(saved[x] for x in below[node])
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        out[min(members[node]), len(node)] = (
            min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), leaves[node], saved[node],
            hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_of(df, rebuilt=True):
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    base = {"base": F.col("conv_id") - F.col("conv_id") % 20, "head": crc % 4} if rebuilt else {}
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = prefix_trie.trie(df, **base).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(160):
        null_at = rng.randrange(40)
        for t in range(rng.choice([1, 2, 3, 9])):
            rows.append((c, None if t == null_at else t, rng.choice(["u", "a", None]), rng.choice(["x y", "x", None, "", "z z z"])))
    rows += [(777, t, "u", f"long {t % 3}") for t in range(2500)]  # spread over several ranges
    rows += [(c, t, "u", f"copy {t}") for c in range(800, 900) for t in range(3)]
    rows += [(901, 0, "u", "w " * 50_000), (None, 1, "u", "no conversation")]
    return [(*r, "clash", 5) for r in rows]


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie(spark, monkeypatch, rebuilt):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)  # ids of a node leave in several chunks
    rows = conversations(5)
    got = trie_of(spark.createDataFrame(rows, TURNS).repartition(5), rebuilt)
    assert got == brute_trie(rows, rebuilt)


def test_trie_with_a_full_sketch(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CELLS", 1 << 13)  # estimates are too high for many singletons
    rows = conversations(6) + [(c, t, "u", f"{c} {t}", "x", 0) for c in range(1000, 3000) for t in range(5)]
    assert trie_of(spark.createDataFrame(rows, TURNS)) == brute_trie(rows)


def test_trie_repeated_rows_are_turns(spark):
    rows = [(1, 0, "u", "a", "", 0)] * 2 + [(2, 0, "u", "a", "", 0)]
    assert trie_of(spark.createDataFrame(rows, TURNS), False) == brute_trie(rows, False)


def test_trie_empty(spark):
    assert trie_of(spark.createDataFrame([], TURNS)) == {}


def test_states_of_ranges_combine():
    whole = [(5, 3, 9, 10), (7, 11, 13, 4), (2, 17, 19, 1)]
    left = prefix_trie.combined(prefix_trie.combined(whole[0], whole[1]), whole[2])
    right = prefix_trie.combined(whole[0], prefix_trie.combined(whole[1], whole[2]))
    assert left == right and left[0] == 14 and left[3] == 15


# --- odd sketches -----------------------------------------------------------------------------------------


def brute_components(rows, k, percent):
    sets, inverse, root = [s for _, s in sets_of(rows, k)], collections.defaultdict(list), {}
    names = [i for i, s in enumerate(sets) if s]
    root = {i: i for i in names}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in names:
        both = collections.Counter(j for x in sets[i] for j in inverse[x])
        for j, n in both.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[find(i)] = find(j)
        for x in sets[i]:
            inverse[x].append(i)
    groups = collections.defaultdict(list)
    for i in names:
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(s), least[find(i)] if s else rows[i][0]) for i, s in enumerate(sets)]


def families(seed):
    """Copies, near copies of one text (mostly not near each other), and texts that share a passage but too little."""
    rng = random.Random(seed)
    rows = corpus(seed, 120)
    words = [rng.choice(WORDS) + str(i) for i in range(90)]
    for i in range(150):
        own = list(words)
        for at in rng.sample(range(90), 2):
            own[at] = f"n{i}"
        rows.append((2000 + i, " ".join(own), "la", "s1"))
    passage = [rng.choice(WORDS) + str(i) for i in range(60)]
    rows += [(3000 + i, " ".join(passage + [f"o{i}x{j}" for j in range(6)]), "lb", "s2") for i in range(150)]
    rows += [(4000 + i, " ".join(passage + [f"p{i // 2}x{j}" for j in range(6)] + [f"q{i}"]), "lb", "s2") for i in range(60)]
    rows += [(5000, "one hot text " * 30, "la", "s1")] * 3 + [(None, None, None, None)]
    return rows


@pytest.mark.parametrize("block", [1024, 16])
def test_odd_sketch_components(documents, monkeypatch, block):
    monkeypatch.setattr(odd_sketch, "BLOCK", block)  # small: buckets are cut in several blocks
    rows = families(3)
    out = odd_sketch.near_copies(documents(rows).repartition(5), k=3, percent=85).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=key) == sorted(brute_components(rows, 3, 85), key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_odd_sketch_empty(spark):
    assert odd_sketch.near_copies(spark.createDataFrame([], EMPTY)).collect() == []


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_bands_hardly_miss(percent):
    rows = odd_sketch.band_rows(percent)
    assert (1 - (percent / 100) ** rows) ** (odd_sketch.SAMPLES // rows) <= odd_sketch.MISSED


def test_odd_sketches_tell_high_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for n, apart in [(400, 10), (400, 30), (2000, 200), (60, 4)] * 5:
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate((a[apart:], rng.integers(0, 1 << 63, apart).astype(np.uint64)))
        least = odd_sketch.samples([np.unique(a), np.unique(b)])
        x, y = odd_sketch.odd_sketch(least).view(np.uint64)
        differ = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + odd_sketch.BITS / (4 * odd_sketch.SAMPLES) * np.log(1 - 2 * differ / odd_sketch.BITS)
        true = (n - apart) / (n + apart)
        errors.append(estimate - true)
        if true >= 0.85:
            assert differ <= odd_sketch.most_flips(85)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15


# --- periodic runs ----------------------------------------------------------------------------------------


def brute_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                found.setdefault((i, length), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def runs(words):
    numbers = {}
    ids = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int64)
    return sorted(zip(*(x.tolist() for x in periodic_runs.runs_of(ids))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(0, 90), st.integers(1, 30))
def test_runs_small_alphabet(words, a, p):
    words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
    assert runs(words) == brute_runs(words)


def test_runs_of_long_texts():
    rng = random.Random(8)
    for n, k, p in [(6000, 3, 17), (5000, 500, 900), (9000, 1, 1)]:
        words = [rng.randrange(k) for _ in range(n)]
        a = n // 3
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert runs(words) == brute_runs(words)


@pytest.mark.parametrize("r", [0, 1, 2])
def test_covers(r):
    v, held, offsets = periodic_runs.cover(r)
    assert held.sum() == 6 * r + 4 and offsets.min() == 0
    for a, b in [(0, 1), (v - 1, 5), (3, 3)]:
        d = offsets[a, b]
        assert held[(a + d) % v] and held[(b + d) % v]


@pytest.mark.parametrize("n", [40, 5000])
def test_extensions(n):
    rng = np.random.default_rng(9)
    words = rng.integers(1, 3, n)
    words[n // 2 :] = words[: n - n // 2]
    own = periodic_runs.Extensions(words)
    i = rng.integers(0, n - 1, 300)
    j = i + 1 + (rng.random(300) * (n - i)).astype(np.int64)
    j[:50] = np.minimum(n, i[:50] + n // 2)
    keep = j > i
    for a, b, got in zip(i[keep], j[keep], own.reach(i[keep], j[keep])):
        want = 0
        while b + want < n and words[a + want] == words[b + want]:
            want += 1
        assert got == want


def test_collapse(documents, spark):
    rows = [(1, "a b a b a b a b c", "x", "s"), (2, None, None, None), (3, "", "x", "s"), (None, "z " * 9, "x", "s"),
            (None, "z " * 9, "x", "s"), (4, "plain words only here", "x", "s"), (5, "é é " * 8 + "end", "x", "s"),
            (6, prose(random.Random(1), 30_000), "x", "s")]
    out = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.collapse(documents(rows)).collect()]
    assert out[:7] == [
        (1, 9, [(0, 8, 2)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (None, 9, [(0, 9, 1)], "z"), (None, 9, [(0, 9, 1)], "z"),
        (4, 4, [], "plain words only here"), (5, 9, [(0, 8, 1)], "é é end")]
    assert out[7][1] == 30_000
    assert periodic_runs.collapse(spark.createDataFrame([], EMPTY)).collect() == []


def test_runs_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()}
    some = 0
    for doc_id, text in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(WORD, text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found, row = brute_runs(words), got[doc_id]
        gone = {i for start, length, q in found for i in range(start + q, start + length)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join("%d,%d,%d\n" % x for x in sorted(found, key=lambda x: (x[0], x[2])))
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(found), *top)
        assert row["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        some += len(found)
    assert some
