"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguises: case, look-alike letters of other scripts, full-width forms, invisible characters
and digits or signs that stand for letters. The lexicon is learned from labelled rows. Its entries are
beginnings of words (whole words too, where those tell more); an entry's weight is the log of how much more
often it stands in toxic texts. It has to tell the kinds apart by texts and also by distinct neighbourhoods
(word before, word after), so that copies of one toxic text do not turn its harmless words into entries.
Phrases around a match that stand in harmless texts only are exceptions and cancel the match. A match's
weight, as a sum and relative to the length of the text, goes through a logistic fit to a score.

Learning reads a bounded sample (``sample`` labelled rows, chosen by a hash of their id); the lexicon and
the exceptions have at most ``entries`` entries each. Scoring reads every row and whole texts.

Defined results: null and empty texts are scored as texts without a match; without labels, or with labels
of one kind only, every score is that kind's share (0 without labels). Null ids or labels are no labels.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import take, trim
from tallywork.session import cut_lineage

# Letters of other scripts and digits that look like a Latin letter.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j",
    "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v",
    "х": "x", "ԝ": "w", "ӏ": "i", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
}
# Signs that stand for a letter, when a letter or digit follows.
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
# l, i and 1 look alike; after folding all are i.
FOLD = str.maketrans(
    LOOKALIKES | {"l": "i"} | {chr(c): None for c in (*range(0x300, 0x370), 0x200B, 0x200C, 0x200D, 0xAD)}
)
SIGN = re.compile(r"[@$!|€](?=\w)")
WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text.lower())
    return SIGN.sub(lambda m: SIGNS[m[0]], plain).translate(FOLD)


# Shortest and longest beginning of a word that can be an entry.
STEM = (3, 12)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # beginnings of words
    exceptions: list[str] = field(default_factory=list)  # phrases of whole words
    base: float = 0.0  # the score where nothing was learned
    fit: tuple[float, ...] = ()  # intercept, of the sum, of the density

    def __len__(self) -> int:
        return len(self.weights)


def matcher(lexicon: Lexicon):
    found = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        found.add_word(phrase, (phrase, None))
    for stem, weight in lexicon.weights.items():
        found.add_word(stem, (stem, weight))
    if len(found):
        found.make_automaton()
    return found


def measure(text: str | None, found) -> tuple[float, int, list[str]]:
    """Weight of the matches that no exception covers, number of words, and the entries matched."""
    folded = fold(text or "")
    words = len(folded.split())
    if not len(found):
        return 0.0, words, []
    hits, covered = [], []
    for end, (key, weight) in found.iter(folded):
        a, b = end - len(key) + 1, end + 1
        if a and folded[a - 1].isalpha():
            continue
        if weight is not None:
            hits.append((a, key, weight))
        elif b == len(folded) or not folded[b].isalpha():
            covered.append((a, b))
    covered.sort()
    starts, ends = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
    hits = [h for h in hits if not (at := bisect_right(starts, h[0])) or h[0] >= ends[at - 1]]
    return sum(h[2] for h in hits), words, [h[1] for h in hits]


def features(weight, words):
    weight, words = np.asarray(weight, float), np.asarray(words, float)
    return np.stack([np.ones_like(weight), np.log1p(weight), np.log1p(1000 * weight / np.maximum(words, 1))], 1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def surprise(a: Column, b: Column, share: float) -> Column:
    """How far ``a`` toxic and ``b`` other counts are from the toxic share (twice the log-likelihood gain)."""
    n = a + b
    return 2 * (a * F.log(F.greatest(a, F.lit(1e-9)) / (n * share)) + b * F.log(F.greatest(b, F.lit(1e-9)) / (n * (1 - share))))


def stems(word: str):
    return (word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1))


def _counts(frames):
    for frame in frames:
        seen: dict[int, Counter] = {}
        for text, toxic in zip(frame["text"], frame["toxic"]):
            seen.setdefault(toxic, Counter()).update({s for w in set(WORD.findall(fold(text))) for s in stems(w)})
        for toxic, counts in seen.items():
            yield pd.DataFrame({"stem": list(counts), "toxic": toxic, "n": list(counts.values())})


def _contexts(entries: set[str]):
    def find(frames):
        for frame in frames:
            rows = set()
            for text, toxic in zip(frame["text"], frame["toxic"]):
                own = ["", *WORD.findall(fold(text)), ""]
                rows.update(
                    (s, toxic, own[i], w, own[i + 2]) for i, w in enumerate(own[1:-1]) for s in stems(w) if s in entries)
            yield pd.DataFrame(list(rows), columns=["stem", "toxic", "before", "word", "after"])

    return find


def chosen(ranked: list[tuple[str, float]]) -> dict[str, float]:
    """Of entries where one begins with another, the first in rank."""
    out: dict[str, float] = {}
    taken: set[str] = set()  # every beginning of what was chosen
    for stem, weight in ranked:
        if weight > 0 and stem not in taken and not any(s in out for s in stems(stem)):
            out[stem] = weight
            taken.update(stems(stem))
    return out


def learn(
    df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = 12_000, entries: int = 1000, least: float = 20.0, ratio: float = 4.0,
) -> Lexicon:
    """Fit lexicon, exceptions and score on at most about ``sample`` of the labelled rows of ``df``."""
    told = take(labels, id=doc_id, toxic=label).where("id is not null and toxic is not null")
    part = min(1.0, sample / max(1, told.count()))
    told = told.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < part * 1_000_000)
    told = told.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # at most about `sample` rows of two numbers
    rows = take(df, id=doc_id, text=text).join(F.broadcast(told), "id")
    rows = cut_lineage(rows.select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = kinds.get(1, 0), kinds.get(0, 0)
    if not n1 or not n0:
        return Lexicon(base=float(n1 > 0))
    share = n1 / (n1 + n0)
    toxic, other = (F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((1, "a"), (0, "b")))
    counted = rows.mapInPandas(_counts, "stem string, toxic int, n long").groupBy("stem").agg(toxic, other)
    gain = surprise(F.col("a"), F.col("b"), share)
    told_apart = (gain >= least) & (F.col("a") >= ratio * share * (F.col("a") + F.col("b"))) & (F.col("a") > F.col("b"))
    ranking = [F.desc(F.round(gain, 6)), F.desc(F.length("stem")), F.col("stem")]
    best = counted.where(told_apart).orderBy(*ranking).limit(10 * entries)
    wanted = {r["stem"] for r in best.collect()}  # at most 10 * entries
    places = rows.mapInPandas(
        _contexts(wanted), "stem string, toxic int, before string, word string, after string").distinct()
    places = cut_lineage(places.withColumn("n", F.lit(1)))
    weight = F.log((F.col("a") + 0.5) / n1) - F.log((F.col("b") + 0.5) / n0)
    own = places.groupBy("stem").agg(toxic, other).where(told_apart).orderBy(*ranking).limit(10 * entries)
    ranked = [(r["stem"], r["w"]) for r in own.select("stem", weight.alias("w")).collect()]
    weights = dict(list(chosen(ranked).items())[:entries])
    phrases = F.array(F.concat_ws(" ", "before", "word"), F.concat_ws(" ", "word", "after"))
    ours = places.where(F.col("stem").isin(list(weights)) if weights else F.lit(False))
    around = ours.withColumn("phrase", F.explode(phrases)).groupBy("phrase").agg(toxic, other)
    harmless = around.where((F.col("b") >= 5) & (F.col("a") == 0)).orderBy(F.desc("b"), "phrase").limit(entries)
    lexicon = Lexicon(weights, [r["phrase"].strip() for r in harmless.collect() if " " in r["phrase"].strip()], share)
    scan = measurer(df.sparkSession, lexicon)
    x = rows.select("toxic", scan(F.col("text")).alias("m")).select("toxic", "m.weight", "m.words").toPandas()
    lexicon.fit = tuple(logistic(features(x["weight"], x["words"]), x["toxic"].to_numpy(float)))
    return lexicon


def measurer(spark, lexicon: Lexicon):
    """A column function: text -> struct(weight, words, matched)."""
    held, made = spark.sparkContext.broadcast(vars(lexicon)), []

    def scan(text: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(matcher(Lexicon(**held.value)))
        found = [measure(t, made[0]) for t in text]
        trim()
        return pd.DataFrame(found, columns=["weight", "words", "matched"])

    return F.pandas_udf(scan, "weight double, words long, matched array<string>")


def score(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``score`` (0 to 1) and the lexicon words ``matched``."""
    told = df.withColumn("_told", measurer(df.sparkSession, lexicon)(F.col(text)))
    if lexicon.fit:
        weight, words = F.col("_told.weight"), F.greatest(F.col("_told.words"), F.lit(1))
        a, b, c = (float(v) for v in lexicon.fit)
        logit = a + b * F.log1p(weight) + c * F.log1p(1000 * weight / words)
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    else:
        value = F.lit(lexicon.base)
    return told.select(*df.columns, value.alias("score"), F.col("_told.matched").alias("matched"))
