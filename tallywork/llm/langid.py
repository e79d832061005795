"""Language identification with bit-sliced Bloom filters over character trigrams.

One filter position holds a mask with one bit for each language. The masks at a trigram's positions,
combined with AND, name all languages whose filter holds the trigram, in one lookup for all of them.
Per language the hits are counted, corrected for the hits that a filter so full gives by chance, and
the language with the largest corrected share is chosen.

Learning reads a bounded sample (``sample`` labelled rows per language, chosen by a hash of the text);
prediction reads every row and whole texts. A trigram enters the filters of the languages in which it
is at least ``share`` times as frequent as in its best language, so that stray foreign words in the
labelled texts do not count.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts of which no
filter knows a trigram get the most frequent language with score 0; ties go to the smaller code; with
no labelled rows at all every row is ``und``. Repeated rows are predicted one by one; other columns,
whatever their names, stay out of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tallywork.llm.common import PIECE, mixed, take

UNKNOWN = "und"
# Odd multipliers of the filter's hash functions (any odd numbers do).
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class Filters:
    languages: list[str]
    fallback: str
    slices: np.ndarray  # (words of 64 languages, positions)
    chance: np.ndarray  # per language: probability that a trigram is found by chance
    letters: np.ndarray  # per code point: is it a letter

    @property
    def bits(self) -> int:
        return int(self.slices.shape[1]).bit_length() - 1


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str], letters: np.ndarray):
    """Trigrams around every letter as packed code points, and where each text's run of them starts."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t.lower()) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # of the middle letters
    is_letter = letters[points]
    points = np.where(is_letter, points, np.uint64(32))
    middle = np.flatnonzero(is_letter)
    grams = (points[middle - 1] << np.uint64(42)) | (points[middle] << np.uint64(21)) | points[middle + 1]
    return grams, np.searchsorted(middle, starts + 1)


def positions(grams: np.ndarray, bits: int) -> list[np.ndarray]:
    spread = mixed(grams)
    return [((spread * np.uint64(s)) >> np.uint64(64 - bits)).astype(np.int64) for s in SEEDS]


def learn(
    df: DataFrame, text: str = "text", lang: str = "lang",
    sample: int = 3000, share: float = 0.5, least: int = 3, bits: int = 18,
) -> Filters:
    """Fit the filters on at most about ``sample`` rows of each language of ``df``.

    The filters are ``2 ** bits`` positions whatever the input; only those come to the driver.
    """
    rows = take(df, text=text, lang=lang).where("lang is not null and text is not null")
    letters = letter_table()
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], UNKNOWN, np.zeros((1, 1 << bits), np.uint64), np.zeros(0), letters)
    part = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample / counts[k]))])
    sampled = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)
    table = df.sparkSession.sparkContext.broadcast(letters)

    def count(frames):
        for frame in frames:
            for key, own in frame.groupby("lang"):
                texts = list(own["text"])
                for i in range(0, len(texts), 200):
                    grams, n = np.unique(trigrams(texts[i : i + 200], table.value)[0], return_counts=True)
                    yield pd.DataFrame({"lang": key, "gram": grams.astype(np.int64), "n": n})

    found = sampled.mapInPandas(count, "lang string, gram long, n long")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in found.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[F.lit(x) for k in languages for x in (k, float(totals.get(k, 1)))])
    rated = found.where(F.col("n") >= least).withColumn("rate", F.col("n") / total[F.col("lang")])
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    kept = rated.join(best, "gram").where(F.col("rate") >= share * F.col("best"))
    kept = kept.select("gram", number[F.col("lang")].alias("language"))

    def place(frames):
        for frame in frames:
            own = frame["language"].to_numpy()
            for at in positions(frame["gram"].to_numpy().astype(np.uint64), bits):
                yield pd.DataFrame({"word": own // 64, "position": at, "bit": np.left_shift(np.int64(1), own % 64)})

    # at most 2 ** bits rows for each 64 languages
    placed = kept.mapInPandas(place, "word int, position long, bit long").groupBy("word", "position")
    filled = placed.agg(F.expr("bit_or(bit)").alias("mask")).toPandas()
    slices = np.zeros((-(-len(languages) // 64), 1 << bits), np.uint64)
    slices[filled["word"], filled["position"]] = filled["mask"].to_numpy().astype(np.int64).view(np.uint64)
    full = [np.count_nonzero(slices[i // 64] & np.uint64(1 << (i % 64))) for i in range(len(languages))]
    chance = (np.array(full) / (1 << bits)) ** len(SEEDS)
    return Filters(languages, max(languages, key=lambda k: (counts[k], k)), slices, chance, letters)


def shares(texts: list[str], model: Filters) -> tuple[np.ndarray, np.ndarray]:
    """Per text and language the corrected share of trigrams, and per text the number of trigrams."""
    grams, cuts = trigrams(texts, model.letters)
    n = np.diff(cuts)
    masks = np.full((model.slices.shape[0], len(grams)), ~np.uint64(0))
    for at in positions(grams, model.bits):
        masks &= model.slices[:, at]
    hits = np.zeros((len(texts), len(model.languages)))
    for i in range(len(model.languages)):
        found = np.concatenate(([0], np.cumsum((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)))
        hits[:, i] = found[cuts[1:]] - found[cuts[:-1]]
    by_chance = np.minimum(model.chance, 0.999)
    return np.maximum(0.0, (hits - n[:, None] * by_chance) / (1 - by_chance)) / np.maximum(n, 1)[:, None], n


def predictor(spark, model: Filters):
    """A column function: text -> struct(lang_pred, score)."""
    held = spark.sparkContext.broadcast(vars(model))

    def predict(text: pd.Series) -> pd.DataFrame:
        model = Filters(**held.value)
        names, scores = [], []
        texts = ["" if t is None else t for t in text]
        start = 0
        while start < len(texts):
            stop, size = start + 1, len(texts[start])
            while stop < len(texts) and size + len(texts[stop]) <= PIECE // 2:
                size += len(texts[stop])
                stop += 1
            share, n = shares(texts[start:stop], model) if model.languages else (None, np.zeros(stop - start))
            for row in range(stop - start):
                if not n[row]:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best, total = int(np.argmax(share[row])), float(share[row].sum())
                names.append(model.languages[best] if total else model.fallback)
                scores.append(float(share[row][best]) / total if total else 0.0)
            start = stop
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(df: DataFrame, model: Filters, text: str | Column = "text") -> DataFrame:
    """Every row of ``df`` with ``lang_pred`` and ``score`` added."""
    told = predictor(df.sparkSession, model)(F.col(text) if isinstance(text, str) else text)
    return df.withColumn("_told", told).select(
        *df.columns, F.col("_told.lang_pred").alias("lang_pred"), F.col("_told.score").alias("score"))
