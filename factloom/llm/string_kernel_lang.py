"""Operator 10, language identification with a blended-spectrum string kernel and kernel ridge regression.

A text is the set of its 1- to 3-grams of letters (case folded, everything else one blank), as presence bits in SLOTS
hashed slots.  The kernel of two texts is the number of slots they share over the geometric mean of their numbers.
LANDMARKS training texts, the same number of each language, span the Nyström approximation: a text's features are its
kernel values with them, times the inverse root of their own kernel matrix.  One ridge regression for each language
against the rest decides which language it is.  That multiplies a batch's bits, at the slots that any landmark has, by
the landmarks' bits, and the result by one matrix that holds the inverse root and the regressions.

The regressions only compare languages, so the score, which says whether a text is of any learned language at all, is
another measure: the share of the text's slots that the training texts of a language hit.  It is compared with the
language's own bound, the share that all but LEFT_OUT of its different training texts reach when each is left out of
its language (for short texts less, by two standard deviations of a share): LEAST_SCORE at the bound, 0 and 1 for none
and all of the slots.  The score is the best of the predicted and all bounded languages, so it does not depend on how
many there are.  A language with fewer than ENOUGH different training texts has no bound, and what is predicted as it
is never rejected.

Training reads only text and lang, of labelled rows that are not held out: at most PER_LANGUAGE different texts of each
language, and ROWS_IN_ALL of all together (documented bounds), those with the smallest hash of text and lang, so every
language has one at least; where there are more than LANGUAGES, the ones with the most rows are learned.  Each language
has a landmark at least.  The texts' bits go to the driver.  Everything else covers all rows and whole texts.

Cases: null text and texts without letters are ``und`` with score 0, also where there is nothing to learn from; null
lang is never learned; a null doc_id counts as held out; one-language tables give that language; repeated rows get the
same answer and are one text to learn from, whatever their ids; an empty table gives none; other columns of any name
are ignored, and keep_known() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import text_of

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
GRAMS = (1, 2, 3)
LANDMARKS = 128
PER_LANGUAGE = 200
LANGUAGES = 128
ROWS_IN_ALL = 12_800
RIDGE = 1e-2
FOLDS = 5
UNKNOWN = "und"
#: The pipeline rejects a document that scores less: a text that belongs to none of the languages learned.
LEAST_SCORE = 0.3
#: The share of a language's own training texts below its bound, and how many different ones a bound takes.
LEFT_OUT = 0.01
ENOUGH = 20
ROWS_AT_ONCE = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    points = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, points, 32).astype(np.uint32)


def presence(text: str) -> np.ndarray | None:
    """The slots that the text's n-grams hit, as booleans; None for a text without letters."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)]
    if not (points != 32).any():
        return None
    blank = points == 32
    again = np.concatenate([[False], blank[1:] & blank[:-1]])
    points = np.concatenate([[32], points[~again], [32]]).astype(np.uint64)
    bits = np.zeros(SLOTS, bool)
    gram = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            gram = gram[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                bits[(gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)] = True
    return bits


@dataclass
class Model:
    """Languages, the slots that count, landmark bits there, their norms, and landmark kernel values to scores (last row: constants).

    For each slot, whether each language's training texts hit it; each language's bound, NaN for none.
    """

    languages: list[str]
    slots: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    hit: np.ndarray
    bounds: np.ndarray

    def belongs(self, bits: np.ndarray, best: int) -> float:
        """How surely a text with these bits, predicted as the language best, is of a learned language: the score."""
        n = np.count_nonzero(bits)
        share = self.hit[bits].sum(axis=0) / n
        usual = np.minimum(self.bounds, 0.95)
        bound = np.maximum(self.bounds - 2 * np.sqrt(usual * (1 - usual) / n), 0)
        bound = np.where(np.arange(len(bound)) == best, np.nan_to_num(bound), bound)
        with np.errstate(divide="ignore", invalid="ignore"):
            above = LEAST_SCORE + (1 - LEAST_SCORE) * np.where(bound < 1, (share - bound) / (1 - bound), 1.0)
            score = np.where(share >= bound, above, LEAST_SCORE * share / bound)
        return float(np.nanmax(score))

    def scores(self, bits: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """bits: rows of presence at self.slots; norms: roots of how many slots each whole text hits."""
        return (bits.astype(np.float32) @ self.landmarks.astype(np.float32).T / norms[:, None] / self.norms[None, :]) @ self.weights[:-1] + self.weights[-1]


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """text, lang and rank of at most per_language different texts of each language, those with the smallest hash."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang", F.xxhash64("text", "lang").alias("hash"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("hash", 0.05).alias("texts"))
    most = counts.orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()  # at most LANGUAGES
    if not most:
        return known.select("lang", F.lit(0).alias("rank"), "text").where("false")
    each = min(per_language, max(1, ROWS_IN_ALL // len(most)))
    # below this hash a language has about four times as many different texts as are wanted, so ranking meets few rows
    upto = {r["lang"]: min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * each // max(1, r["texts"])) for r in most}
    bound = F.create_map(*[F.lit(x) for lang, top in upto.items() for x in (lang, top)])[F.col("lang")]
    # hashes are ranked first; then only the few texts that they name are read
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    chosen = known.where(F.col("hash") <= bound).select("lang", "hash").distinct().withColumn("rank", rank).where(F.col("rank") <= each)
    return known.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))  # at most ROWS_IN_ALL rows


def _unpacked(packed: list[bytes], slots: np.ndarray | slice = slice(None)) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)[:, slots].astype(np.float32)


def fit(docs: DataFrame, landmarks: int = LANDMARKS, per_language: int = PER_LANGUAGE, ridge: float = RIDGE) -> Model | None:
    """The model of docs' labelled rows, or None if there are none."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = [presence(t) for t in b["text"]]
            yield pd.DataFrame({"lang": b["lang"], "rank": b["rank"], "bits": [None if x is None else np.packbits(x).tobytes() for x in bits]})

    got = training_rows(docs, per_language).mapInPandas(pack, "lang string, rank long, bits binary").toPandas().dropna(subset=["bits"])
    return solve(got, landmarks, ridge) if len(got) else None


def solve(got: pd.DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The model of training texts: lang, rank, bits (packed).  Whole bits are unpacked for a portion of them at a time."""
    got = got.sort_values(["rank", "lang"], kind="stable").reset_index(drop=True)
    packed, languages = got["bits"].tolist(), sorted(got["lang"].unique())
    # ranks alternate between the languages, but every language's first text leads
    lead = got.groupby("lang", sort=False).cumcount().to_numpy()
    first = np.argsort(lead > 0, kind="stable")[: min(max(landmarks, len(languages)), len(got))]
    own = _unpacked([packed[i] for i in first])
    slots = np.flatnonzero(own.any(axis=0))
    own = own[:, slots]
    hit, texts = np.zeros((SLOTS, len(languages)), np.uint8), np.zeros((len(languages), SLOTS))
    kernel, norms = np.zeros((len(got), len(first)), np.float32), np.zeros(len(got))
    different = ~got.duplicated(["lang", "bits"]).to_numpy()
    of = np.array([languages.index(x) for x in got["lang"]])
    for at in range(0, len(got), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        bits = _unpacked(packed[part])
        norms[part] = np.sqrt(bits.sum(axis=1))
        kernel[part] = bits[:, slots] @ own.T
        np.add.at(texts, of[part][different[part]], bits[different[part]])
    hit[:] = (texts > 0).T
    kernel = kernel / norms[:, None] / norms[first][None, :]
    values, vectors = np.linalg.eigh(kernel[first].astype(float))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel.astype(float) @ root
    target = np.where(got["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    bias = np.hstack([features, np.ones((len(got), 1))])
    solved = np.linalg.solve(bias.T @ bias + ridge * len(got) / 100 * np.diag([1.0] * features.shape[1] + [1e-9]), bias.T @ target)
    weights = np.vstack([root @ solved[:-1], solved[-1:]])
    bounds = np.full(len(languages), np.nan)
    for i in range(len(languages)):
        rows = np.flatnonzero((of == i) & different)
        if len(rows) >= ENOUGH:
            twice = np.flatnonzero(texts[i] > 1)
            shares = [_unpacked([packed[r] for r in rows[at : at + ROWS_AT_ONCE]], twice).sum(axis=1) for at in range(0, len(rows), ROWS_AT_ONCE)]
            bounds[i] = np.quantile(np.concatenate(shares) / norms[rows] ** 2, LEFT_OUT)
    return Model(languages, slots, own.astype(np.uint8), norms[first].astype(np.float32), weights.astype(np.float32), hit, bounds)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; the model is learned from docs if none is given."""
    told = judge(docs, model or fit(docs))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), told(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def judge(docs: DataFrame, model: Model | None) -> Callable[[Column], Column]:
    """A function of a text column: lang_pred and score."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        m = told.value
        lang, score = np.full(len(text), UNKNOWN, dtype=object), np.zeros(len(text))
        if m is None:
            return pd.DataFrame({"lang_pred": lang, "score": score})
        names = np.array(m.languages, dtype=object)
        for at in range(0, len(text), ROWS_AT_ONCE):
            rows, hits, bits, norms = [], [], [], []
            for i, t in enumerate(text.iloc[at : at + ROWS_AT_ONCE]):
                if t and (hit := presence(t)) is not None:
                    rows.append(at + i), hits.append(np.packbits(hit)), bits.append(hit[m.slots]), norms.append(np.sqrt(hit.sum()))
            if rows:
                got = m.scores(np.array(bits), np.array(norms, np.float32))
                best = got.argmax(axis=1)
                lang[rows] = names[best]
                score[rows] = [m.belongs(np.unpackbits(hit).view(bool), b) for hit, b in zip(hits, best, strict=True)]
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return predict


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs whose language is known with at least that score, with all their columns.

    Where there is nothing to learn from, all rows with letters stay.
    """
    model = fit(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    told = docs.select(F.struct("*").alias("row"), judge(docs, model)(F.col("text").cast("string")).alias("told"))
    return told.where((F.col("told.lang_pred") != UNKNOWN) & (F.col("told.score") >= least)).select("row.*")
