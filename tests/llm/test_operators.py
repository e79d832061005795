"""Every operator against a brute-force version on small texts, with the edge cases its docstring defines."""

import base64
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywork.llm import (
    adaptive_rules, components, cube_mix, decontamination, histogram_sort, html_text, jaccard_join, langid,
    suffix_dedup, toxicity, warc,
)

WORDS = [w + e for w in "al be cor du en fi gra ho il ju ka lo mi no".split() for e in ("", "ra", "tis", "um")]
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([0, 2, 5, 40, 120, 300])) for _ in range(n)]
    passage = prose(rng, 25)
    rows = []
    for i, t in enumerate(texts):
        if i % 5 == 1:
            t = t + " " + passage
        if i % 7 == 2 and i > 20:
            words = texts[i - 20].split()
            t = " ".join(words[:-1] + ["edited"]) if words else t
        if i % 11 == 3 and i > 20:
            t = texts[i - 20]
        rows.append((i, t, ["la", "lb", None][i % 3], ["s1", "s2", None, "s3"][i % 4]))
    rows += [(1000, None, None, None), (1001, "", "la", "s1"), (None, texts[5], "la", "s1"), (3, texts[3], "la", "s1"),
             (1002, "é" * 400, "la", "s2"), (1003, " \t\n ", "lb", None), (1004, "same " * 200, "lb", "s2")]
    return rows


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- mixing -----------------------------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, total, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        level = total / sum(weight[s] for s in open_)
        above = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not above:
            out.update({s: level * weight[s] for s in open_})
            break
        for s in above:
            out[s] = most * sizes[s]
            total -= out[s]
        open_ -= above
    return out


def test_mix_targets_and_totals(documents):
    rows = corpus(2, 400)
    out = cube_mix.mix(documents(rows), chunk=50).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = filled(sizes), collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(325, 0.01 * want[s])  # one document
    again = cube_mix.mix(documents(rows).repartition(7), chunk=50).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_flight_keeps_totals():
    import numpy as np

    rng = np.random.default_rng(3)
    size = np.sort(rng.integers(0, 500, 300).astype(float))[::-1]
    p = np.full(300, 0.37)
    q = cube_mix.flight(size, p, rng.random(300))
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * size).sum() == pytest.approx((p * size).sum())


def test_mix_empty(spark):
    assert cube_mix.mix(spark.createDataFrame([], EMPTY)).collect() == []


# --- sharding ---------------------------------------------------------------------------------------------


def test_shards(documents, spark):
    rows = corpus(4, 300) + [(5000 + i, "one hot text " * 20, "la", "s1") for i in range(400)]
    out = histogram_sort.shard(documents(rows), 8, cell_rows=40).collect()
    assert len(out) == len(rows)
    total, slots, sizes = 0, collections.defaultdict(list), collections.Counter()
    crc = {i: zlib.crc32(t.encode()) for i, t, _, _ in rows if t is not None}
    for r in out:
        if r["doc_id"] != 1000 and r["doc_id"] is not None:
            assert r["text_crc32"] == crc[r["doc_id"]]
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    total = sum(sizes.values())
    assert total == sum(len((t or "").encode()) + 16 for _, t, _, _ in rows)
    longest = max(len((t or "").encode()) for _, t, _, _ in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(sizes[k] - total / 8) <= longest + 16 for k in range(8))
    assert histogram_sort.shard(spark.createDataFrame([], EMPTY), 4).collect() == []


# --- language ---------------------------------------------------------------------------------------------


def test_language(spark):
    rng = random.Random(5)
    one = [a + b for a in ("the", "ing", "wh", "sh") for b in ("er", "th", "ou", "ed")]
    two = [a + b for a in ("sch", "ein", "pf", "ge") for b in ("ung", "keit", "ö", "zu")]
    rows = [(i, " ".join(rng.choice((one, two)[i % 2]) for _ in range(30)), ("en", "de")[i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    tests = [*rows[:10], (100, None, None), (101, "12 !? 34", None), (102, "", None), (103, "ЖЖЖ", None), (104, "the" * 50_000, "en")]
    out = by_id(langid.identify(spark.createDataFrame(tests, docs.schema), model))
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:10])
    assert [out[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and out[103]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[104]["lang_pred"] == "en"
    nothing = langid.learn(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, nothing).collect()} == {"und"}


# --- archives ---------------------------------------------------------------------------------------------


def test_archives(spark):
    html = {i: f"<p>page {i % 40} " + "x" * (i % 7) for i in range(120)} | {500: "", 501: None, 502: "ü" * 100_000}
    rows = [(i, None if i == 3 else f"http://h/{i}\r\nx", h) for i, h in html.items()]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert set(out) == set(html)
    first = {}
    for i in sorted(html):
        payload = (html[i] or "").encode()
        r = out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert r["error"] is None
        keeper = first.setdefault(payload, i)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if keeper == i else ("revisit", keeper))
        if keeper == i:
            assert bytes(r["payload"]) == payload
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_records():
    import zstandard

    good = warc.encode(7, "http://h/", b"body", warc.sha1_base32(b"body"), None, "2024-01-01T00:00:00Z")
    pack = zstandard.ZstdCompressor().compress
    bad = [good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-2], good.replace(b"WARC-Date", b"No-Date")]
    data = b"".join(map(pack, [good, *bad, good])) + warc.skippable(0x184D2A51, b"abc") + pack(good)[:-3]
    rows = list(warc.records(data))
    assert [r["error"] is None for r in rows] == [True, False, False, False, False, True, False]


def test_frames_without_content_size():
    import zstandard

    def page(i):
        body = f"body {i} ".encode() * 300_000
        return warc.encode(i, "http://h/", body, warc.sha1_base32(body), None, "2024-01-01T00:00:00Z")

    def streamed(raw):
        writer = zstandard.ZstdCompressor(write_checksum=True).compressobj()
        return writer.compress(raw) + writer.flush()

    frames = [streamed(page(i)) for i in range(3)]
    assert all(zstandard.frame_content_size(f) < 0 for f in frames)
    rows = list(warc.records(b"".join(frames)))
    assert [(r["page_id"], r["payload_bytes"], r["error"]) for r in rows] == [(i, 300_000 * 7, None) for i in range(3)]
    frames[1] = zstandard.ZstdCompressor().compress(b"x" * 5_000_000)  # small on disk, large in memory
    rows = list(warc.records(b"".join(frames), most=3_000_000))
    assert [r["page_id"] for r in rows] == [0, None, 2] and "more than 3000000 bytes" in rows[1]["error"]


def test_archives_of_odd_tables(spark):
    rows = [(None, "u", "a", 1), (None, None, "a", 2), (5, "u", "a", 3), (5, "u", "a", 4), (7, "u", None, 5), (8, "u", "", 6), (None, "u", "only", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, PAYLOAD int")
    out = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(pages).collect())
    assert out == [(0, "response", None, 4), (0, "revisit", 5, 1), (0, "revisit", 5, 1), (5, "response", None, 1), (5, "response", None, 1),
                   (7, "response", None, 0), (8, "revisit", 7, 0)]


# --- near copies ------------------------------------------------------------------------------------------


def sets_of(rows, k):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        out.append((i, s))
    return out


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(documents, k, percent):
    rng = random.Random(9)
    base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(150)]
    near = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        near.append((2000 + i, " ".join(w).upper() if i % 9 == 0 else " ".join(w), "la", "s1"))
    rows = corpus(8, 150) + near
    sets = sets_of(rows, k)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both and 100 * both >= percent * len(sets[x][1] | sets[y][1]):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        ids = [v for v in (least.get(find(x)), i) if v is not None]
        least[find(x)] = min(ids) if ids else None
    want = collections.Counter((i, len(s), least[find(x)] if s else i) for x, (i, s) in enumerate(sets))
    out = jaccard_join.join(documents(rows), k=k, percent=percent).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == want
    kept = collections.Counter(r["component_id"] for r in out if r["kept"] and r["n_shingles"])
    assert set(kept) == {c for _, n, c in want if n} and all(r["doc_id"] == r["component_id"] for r in out if r["kept"] and r["n_shingles"])


def test_jaccard_group_of_mixed_sizes(spark):
    # a query of 200 tokens is linked with the member of 170 only; five of the six tokens met are the other member's
    triples = 40
    postings, sizes, roots = [], [], []
    for i in range(triples):
        q, b, c = 3 * i, 3 * i + 1, 3 * i + 2
        sizes += [(q, 200), (b, 170), (c, 200)]
        roots += [(b, b), (c, b)]
        postings += [(100 * i + j, x) for j in range(5) for x in (q, c)] + [(100 * i + 5, x) for x in (q, b, c)]
    blocks = jaccard_join.matrix_blocks(
        spark.createDataFrame(postings, "token long, cid long"), spark.createDataFrame(sizes, "cid long, n long"),
        spark.createDataFrame(roots, "node long, root long"), 85)
    assert {r["cid"] for r in blocks.where("query").collect()} >= {3 * i for i in range(triples)}


def test_jaccard_links_to_smallest_member(documents):
    rows = []
    for i in range(150):
        word = lambda kind, n: [f"{kind}{i}x{j}" for j in range(n)]
        both = word("b", 170)
        for j, own in enumerate((both, both + word("c", 25) + word("s", 5), both + word("q", 25) + word("s", 5))):
            rows.append((3 * i + j, " ".join(own), "la", "s1"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(documents(rows), k=1, percent=85).collect()}
    assert got == {i: 3 * (i // 3) for i in range(len(rows))}


@pytest.mark.parametrize("percent", [80, 85])
def test_parity_bound_keeps_links(percent):
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 60, 255, 257, 700, 5000):
        for share in (0.0, 0.05, 0.1, 0.17, 0.4, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate((a[int(share * len(a)):], rng.integers(0, 1 << 63, int(share * n * rng.random())).astype(np.uint64))))
            if not len(b):
                continue
            x, y = (np.frombuffer(jaccard_join.parity(t), np.uint8)[None, :] for t in (a, b))
            wide = min(x.shape[1], y.shape[1])
            apart = int(np.bitwise_count(jaccard_join.folded(x, wide) ^ jaccard_join.folded(y, wide)).sum())
            assert apart <= len(np.setxor1d(a, b))
            if jaccard_join.linked(a, b, percent):
                assert apart <= jaccard_join.most_apart(len(a), len(b), percent)


@pytest.mark.parametrize("k", [1, 4, 5, 7])
def test_pieces_of_few_words(k):
    for n in range(8):
        (own,) = jaccard_join.shingle_sets([" ".join(WORDS[:n])], k)
        assert len(own) == (max(1, n - k + 1) if n else 0)


def test_jaccard_tables_of_few_words(documents):
    for n in range(1, 5):
        (row,) = jaccard_join.join(documents([(7, " ".join(WORDS[:n]), "la", "s1")]), k=5).collect()
        assert (row["doc_id"], row["n_shingles"], row["component_id"], row["kept"]) == (7, 1, 7, True)


def test_jaccard_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], EMPTY)).collect() == []


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b}
    assert {i: r for i, r in got.items()} == {i: find(i) for i in root if i not in alone or i in got}


# --- toxicity ---------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1D10T") == toxicity.fold("idiot") == toxicity.fold("іdіоt") == toxicity.fold("ｉｄｉｏｔ")
    assert toxicity.fold("$tup!d") == "stupid" and toxicity.fold("good!") == "good!"


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["scoundrel", "villain", "rascal"]
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        elif i % 5 == 1:
            words.insert(10, "lovable rascal")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (399, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    tests = [(1, "a plain text of nothing much"), (2, prose(rng, 30) + " 5c0undre1 " + prose(rng, 5) + " vıllaın"), (3, None), (4, ""),
             (5, prose(rng, 20000)), (6, "you lovable rascal")]
    out = by_id(toxicity.score(spark.createDataFrame(tests, docs.schema), lexicon))
    assert out[2]["score"] >= 0.5 and all(out[i]["score"] < 0.5 for i in (1, 3, 4, 5, 6))
    told = by_id(toxicity.score(docs, lexicon))
    right = sum((told[i]["score"] >= 0.5) == bool(y) for i, y in labels[:400])
    assert right >= 390
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


# --- rules ------------------------------------------------------------------------------------------------


def brute_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_rules(documents, spark):
    rng = random.Random(11)
    rows = corpus(12, 120) + [
        (3000, "a\nb\n a\na\n\n\nb", "la", "s1"), (3001, "x # y *$ | <b>", "la", "s1"), (3002, "a b c a b c a b", "la", "s1"),
        (3003, " ".join(w + "#%&" for w in prose(rng, 80).split()), "la", "s1"), (3004, prose(rng, 90), "la", "s1")]
    out = by_id(adaptive_rules.judge(documents(rows)))
    for i, t, *_ in rows:
        if i in (None, 3):
            continue
        r, want = out[i], brute_measures(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert not out[3003]["kept"] and out[3004]["kept"]
    assert adaptive_rules.judge(spark.createDataFrame([], EMPTY)).collect() == []


# --- decontamination --------------------------------------------------------------------------------------


def test_decontamination(documents, spark):
    rng = random.Random(7)
    items = [("a", prose(rng, 30)), ("b", prose(rng, 13)), ("c", "Short, item-9!"), ("d", None), ("e", " .,"), (None, prose(rng, 20)), ("a", prose(rng, 15))]
    rows = corpus(13, 40)
    rows += [(4000 + i, prose(rng, 20) + "; " + (t or "").upper().replace(" ", " -- ") + ". " + prose(rng, n), "la", "s1")
             for i, (_, t) in enumerate(items) for n in (3, 400)][::1]
    rows = [(r[0], *r[1:]) if r[0] is None or r[0] < 4000 else (4000 + k, *r[1:]) for k, r in enumerate(rows)]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = lambda t: pattern.findall(lower(t))
    out = decontamination.decontaminate(documents(rows), spark.createDataFrame(items, "item_id string, text string"), block_bytes=150)
    seen = 0
    for r in out.collect():
        w, hit, ids = words(r["text"]), set(), set()
        for item, t in items:
            own = words(t)
            for i in range(max(1, len(own) - 12) if own else 0):
                window = own[i : i + 13]
                for j in range(len(w) - len(window) + 1):
                    if w[j : j + len(window)] == window:
                        hit.update(range(j, j + len(window)))
                        ids.add("" if item is None else item)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(ids))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        seen += bool(hit)
    assert seen >= 8
    none = decontamination.decontaminate(documents(rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("n_hit > 0").count() == 0


def test_offsets():
    text = "Äpfel, UND  birnen -- pflaumen"
    assert [text[a:b] for a, b in decontamination.character_spans(text, [(1, 3), (0, 1)])] == ["UND  birnen", "Äpfel"]


# --- rendering --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "text"), [
    ("<p>one<p>two", "one\n\ntwo"),
    ("<ul><li>a<li>b<ol><li>x<li>y</ol><li>c</ul>", "* a\n* b\n  1. x\n  2. y\n* c"),
    ("<table><tr><th>k<th>value<tr><td>longer<td>1</table>", "k      | value\nlonger | 1"),
    ("<div>a<script>var t='</p>'</script> b</div><div style='display: none'>no</div><b hidden>no</b>c", "a b\nc"),
    ("x &amp; y<br>z<!-- no --><pre>  a\n   b</pre>", "x & y\nz\n\n  a\n   b"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl></p></b>end", "t\nd\nu\ne\n\nend"), ("", ""),
    ("<head><title>no</title></head><body><h1>T</h1>text", "T\n\ntext"), ("plain", "plain"),
])
def test_rendering(html, text):
    assert html_text.to_text(html) == text


@pytest.mark.parametrize("html, text", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</p>", "so x=2 holds"),
    ("<p>see <svg><title>t</title><desc>d</desc> <g>no<text>one</text><text>two</text></g></svg> here</p>", "see one two here"),
    ("<p><svg><defs/><path/><text>one</text></svg> two <svg/>three <desc>four</desc> <g>five</g></p>", "one two three four five"),
    ("<form>Say <textarea>my words</textarea> or <select><option>red<option>blue</select>.</form>", "Say my words or red blue ."),
    ("<head><title>t</title><b>first</b> words<p>next</p>", "first words\n\nnext"),
    ("<head><meta charset=x>\n bare text<p>next</p></head>", "bare text\n\nnext"),
    ("<head><script>s</script>\n<style>c</style><link rel=x></head><body>body", "body"),
])
def test_rendering_of_forms_formulas_drawings_and_open_heads(html, text):
    assert html_text.to_text(html) == text


def test_rendering_depth_and_null(spark):
    assert html_text.to_text("<div>" * 20_000 + "deep") == "deep"
    rows = spark.createDataFrame([(1, None), (2, "<p>a")], "page_id long, html string")
    assert [r["t"] for r in rows.orderBy("page_id").select(html_text.text_of("html").alias("t")).collect()] == [None, "a"]


# --- passages ---------------------------------------------------------------------------------------------


def test_suffix_dedup(documents, spark, monkeypatch):
    rows = corpus(21, 120) + [(6000 + i, "ab" * 200, "la", "s1") for i in range(3)] + [(None, prose(random.Random(21), 60), "la", "s1")]
    ordered = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in ordered:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    want = collections.Counter()
    for (i, b), row in zip(ordered, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        want[row[0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    out = suffix_dedup.dedup(documents(rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == want
    assert suffix_dedup.dedup(spark.createDataFrame([], EMPTY)).collect() == []


def brute_removal(rows):
    """Counter of doc_id, bytes, removed bytes, spans and hash of what is left, by a table of all 50-byte strings."""
    ordered = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in ordered:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            first[s] = min(first.get(s, i), i)
    want = collections.Counter()
    for (i, b), row in zip(ordered, rows):
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[row[0], len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    return want


def test_suffix_dedup_texts_of_one_id(documents):
    rng = random.Random(5)
    passages = [prose(rng, 20) for _ in range(30)]
    rows = [(i, prose(rng, 10) + " " + p) for i, p in enumerate(passages)]
    text = lambda: " ".join([prose(rng, rng.randrange(1, 30)), rng.choice(passages), prose(rng, rng.randrange(1, 30))])
    rows += [(None, text()) for _ in range(3000)] + [(500, text()) for _ in range(1000)] + [(-3, text()) for _ in range(3)]
    rows += [rows[40], rows[40], (600, rows[41][1]), (600, text()), (10, None), (10, "")]
    out = suffix_dedup.dedup(documents([(i, t, "la", "s1") for i, t in rows])).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_removal(rows)


def test_long_texts_are_cut_in_blocks():
    import numpy as np

    rng = random.Random(1)
    raw = prose(rng, 300_000).encode()
    assert len(raw) > suffix_dedup.BLOCK
    runs = suffix_dedup.Runs(50)
    _, _, first, last = runs.cut(raw)
    assert first[0] == 0 and last[-1] == len(raw) - 50 and np.array_equal(first[1:], last[:-1] + 1)
    hashes, at = runs.windows(raw, first, last)
    assert np.array_equal(np.sort(at), np.arange(len(raw) - 49))
    assert len(np.unique(hashes)) == len({raw[i : i + 50] for i in range(len(raw) - 49)})


def test_slices_of_a_batch_lose_no_row():
    import pyarrow as pa

    from tallywork.llm.common import slices

    texts = ["a" * n for n in (0, 3, 5, 40, 1)] + [None, "é" * 4, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "n"]).slice(1)
    parts = list(slices(batch, limit=8))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(1, len(texts)))
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 8 for p in parts)
    assert list(slices(batch.slice(0, 0))) == []


def test_index_family_marks_what_one_scan_would():
    rng = np.random.default_rng(12)
    n = 4000
    entries = {
        "k": rng.integers(0, 500, n).astype(np.uint64), "s": rng.integers(0, 3, n).astype(np.uint32), "id": rng.integers(0, 60, n),
        "tag": np.zeros(n, np.int64), "at": np.arange(n, dtype=np.uint32)}
    family, start = suffix_dedup.IndexFamily(), 0
    for size in [1, 7, 300, 2, 900, 50, 50, 50, 1200, 0, 1440]:
        family.enter({c: v[start : start + size] for c, v in entries.items()})
        start += size
    assert start == n and len(family.levels) < 8 and sum(map(len, family.levels)) == n
    found = family.found()
    rows = list(zip(*(entries[c].tolist() for c in ("k", "s", "id", "at"))))
    least, docs = {}, collections.defaultdict(set)
    for k, s, i, _ in rows:
        least[k, s] = min(least.get((k, s), i), i)
        docs[k].add((s, i))
    full = {at for k, s, i, at in rows if i > least[k, s]}
    other = {at for k, s, i, at in rows if any(t != s and j != i for t, j in docs[k])}
    got = dict(zip(found["at"].tolist(), found["whole"].tolist()))
    assert {at for at, whole in got.items() if whole} == full
    assert other - full <= {at for at, whole in got.items() if not whole}


def test_jaccard_texts_that_share_a_passage(documents):
    """Texts far below the threshold that share a long passage, and some that are above it."""
    rng = random.Random(31)
    passage = [rng.choice(WORDS) + str(i) for i in range(80)]
    rows = [(i, " ".join(passage + [f"a{i}x{j}" for j in range(8)]), "la", "s") for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"b{i // 3}x{j}" for j in range(7)] + [f"c{i}"]), "la", "s") for i in range(30)]
    rows += [(200 + i, " ".join(passage[:70] + [f"d{i % 2}"] * (1 + i % 4)), "la", "s") for i in range(20)]
    out = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(documents(rows), k=4, percent=85).collect()}
    sets, root = dict(sets_of(rows, 4)), {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert out == {i: find(i) for i in sets}


@pytest.mark.parametrize("percent", [80, 85])
def test_least_shared_is_a_lower_bound(spark, percent):
    rows = [(n, low, high) for n in [1, 2, 6, 7, 20, 87, 147, 500] for low in range(max(1, n - 90), n + 90, 7) for high in (low, low + 3, low + 40)]
    rows = [r for r in rows if percent * r[1] <= 100 * r[0] and 100 * r[2] >= percent * r[0]]
    out = spark.createDataFrame(rows, "n long, low long, high long").withColumn("least", jaccard_join.least_shared("n", "low", "high", percent))
    for n, low, high, least in out.collect():
        true = [-(-percent * (n + m) // (100 + percent)) - -(-percent * max(n, m) // 100) + 1
                for m in range(low, high + 1) if percent * max(n, m) <= 100 * min(n, m)]
        if true:
            assert min(true) - 1 <= least <= min(true)


def test_toxic_words_inside_exceptions():
    """Matches inside any exception phrase do not count; many of both take no longer than each alone."""
    lexicon = toxicity.Lexicon({"bad": 1.0, "worse": 2.0}, ["not bad", "bad run worse", "worse off"], 0.5)
    found = toxicity.matcher(lexicon)
    rng = random.Random(6)
    for _ in range(200):
        words = [rng.choice(["bad", "worse", "not", "run", "off", "same"]) for _ in range(rng.randrange(40))]
        gone = set()
        for phrase in lexicon.exceptions:
            p = phrase.split()
            for i in range(len(words) - len(p) + 1):
                if words[i : i + len(p)] == p:
                    gone.update(range(i, i + len(p)))
        want = sum(lexicon.weights.get(w, 0.0) for i, w in enumerate(words) if i not in gone)
        assert toxicity.measure(" ".join(words), found)[0] == pytest.approx(want)
    start = time.process_time()
    toxicity.measure("bad not bad worse off " * 40_000, found)
    assert time.process_time() - start < 20


def test_decontamination_in_many_blocks(documents, spark):
    """Windows of different blocks overlap in a text; words are counted once, items of all blocks are listed."""
    words = [f"w{i}" for i in range(60)]
    items = [("b", " ".join(words[:20])), ("a", " ".join(words[10:30])), ("é", " ".join(words[40:55])), ("z", "nothing of it")]
    texts = [(1, " ".join(["x"] * 5 + words + ["y"] * 9)), (2, " ".join(words[12:30])), (3, None), (4, "plain")]
    frame = spark.createDataFrame(items, "item_id string, text string")
    out = by_id(decontamination.decontaminate(documents([(i, t, "la", "s") for i, t in texts]), frame, block_bytes=60))
    whole = by_id(decontamination.decontaminate(documents([(i, t, "la", "s") for i, t in texts]), frame))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert all(out[i][c] == whole[i][c] for i, _ in texts for c in names)
    assert (out[1]["n_hit"], out[1]["n_items"]) == (45, 3) and out[1]["items_sha256"] == hashlib.sha256("a,b,é".encode()).hexdigest()
    assert (out[2]["n_hit"], out[2]["n_items"], out[3]["n_words"], out[3]["n_hit"], out[4]["n_items"]) == (18, 1, 0, 0, 0)


def test_decontamination_blocks_are_bounded(spark):
    """Blocks are cut by the memory their automaton takes, inside an item too; no window is lost."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(30_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:40])), (3, "")], "item_id long, text string")
    limit = 8 << 20
    blocks = list(decontamination.item_blocks(items, "item_id", "text", 13, limit))
    assert len(blocks) > 3 and all(b.bytes < limit + 2_000 for b in blocks)
    assert sum(len(b.items) for b in blocks) == 30_000 - 12 + (28 if len(blocks) > 1 else 0)
    for b in blocks:
        states = b.automaton().get_stats()
        assert states["total_size"] <= limit
    met = [decontamination.scan(" ".join(["and"] + words + ["so"]), b.words, b.automaton()) for b in blocks]
    hit = {i for _, spans, _ in met for a, z in spans for i in range(a, z)}
    assert hit == set(range(1, 30_001)) and set.union(*[ids for _, _, ids in met]) == {"1", "2"}


def test_decontamination_of_no_documents(documents, spark):
    items = spark.createDataFrame([(1, "one two"), (2, " ".join("abcdefghijklmnop"))], "item_id long, text string")
    for limit in (1, 1 << 20):
        assert decontamination.decontaminate(documents([]), items, block_bytes=limit).collect() == []


@pytest.mark.parametrize("html, text", [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td colspan=2>f</table>", "a | b | c\nd |   | e\nf |"),
    ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
    ("<table><tr><td rowspan=x colspan=0>a<td>b<tr><td>c</table>", "a | b\nc"),
    ("<details>x<summary>s</summary><p>y</details>z", "s\nz"),
    ("<details open><summary>s</summary><p>y</details>z", "s\n\ny\n\nz"),
    ("a<dialog>x</dialog><dialog open> b</dialog>", "a b"),
    ("<p style='visibility:hidden'>x <b style='visibility: visible'>y</b> z<img alt=i></p>w", "y\n\nw"),
    ("<p style='visibility:visible'>x</p><div style='display:none'><b style='visibility:visible'>y</b></div>", "x"),
    ("<b>a</b> <i> b</i>\n<u>c</u>", "a b c"),
    ("<pre>a\n\n  b</pre>", "a\n\n  b"),
])
def test_rendering_of_spans_and_covered_parts(html, text):
    assert html_text.to_text(html) == text


def test_rendering_takes_time_in_proportion(spark):
    n = 20_000
    for html, text in [
        ("<div>" * n + "deep", "deep"), ("<b>" * n + "<p>x" * n, "\n\n".join(["x"] * n)),
        ("<b>a</b> " * n, " ".join(["a"] * n)), ("<ul><li>" * 2_000 + "a", "  " * 1_999 + "* a"),
        ("<table><tr>" + "<td>a" * n, " | ".join("a" * n)), ("<i>" * n + "</b>" * n + "x", "x"),
    ]:
        start = time.process_time()
        assert html_text.to_text(html) == text
        assert time.process_time() - start < 5
    pages = spark.createDataFrame([], "page_id long, html string").select(html_text.text_of("html").alias("t"))
    assert pages.collect() == []
