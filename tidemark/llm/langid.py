"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, elastic-net penalties), then calibrated
with one temperature. N-grams are hashed into a fixed table, so a model has one size at any scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task, learned_from, small_batches

BITS, ORDERS = 16, 3
#: The classifier is fitted on about this many documents of each language, those with the smallest id hashes.
SAMPLE_PER_LANGUAGE = 1000
BLOCK = 1 << 20
U = np.uint64


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of the 1- to 3-grams of a whole text's letters, lower-cased, words fenced by spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kept = letter | np.r_[False, letter[:-1]]
    codes = np.r_[np.uint32(32), np.where(letter, codes, np.uint32(32))[kept], np.uint32(32)].astype(U)
    total = np.zeros(0, np.int64)
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + ORDERS - 1]
        grams, h = [], part[: min(BLOCK, len(part))]
        for n in range(ORDERS):
            if n:
                h = (h[: max(0, len(part) - n)] * U(0x100000001B3)) ^ part[n : n + len(h)]
            hashed = (h * U(0x9E3779B97F4A7C15) + U(n)) * U(0xC2B2AE3D27D4EB4F) >> U(64 - BITS)
            grams.append(hashed[part[: len(h)] != 32] if n == 0 else hashed)
        counts = np.bincount(np.concatenate(grams).astype(np.int64), minlength=1 << BITS)
        total = counts if not len(total) else total + counts
    features = np.flatnonzero(total)
    return features, total[features]


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row for each feature, then the intercepts
    temperature: float = 1.0

    def vector(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[features]
        return x / max(np.linalg.norm(x), 1e-12)

    def margins(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(features, counts) @ self.weights[features] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; ``und`` and 0 for a null text, one without letters, or an empty model."""
        features, counts = ngram_counts(text or "")
        if not len(features) or not self.languages:
            return "und", 0.0
        p = softmax(self.margins(features, counts) / self.temperature)
        return self.languages[best := int(p.argmax())], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_features: int, n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights of shape (features + 1, classes); the last row has the intercepts."""
    z, n = np.zeros((n_features + 1, n_classes)), np.zeros((n_features + 1, n_classes))

    def now(rows: np.ndarray) -> np.ndarray:
        zr = z[rows]
        return np.where(np.abs(zr) <= l1, 0.0, -(zr - np.sign(zr) * l1) / ((beta + np.sqrt(n[rows])) / alpha + l2))

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(labels)):
            features, x = vectors[i]
            rows, x = np.r_[features, n_features], np.r_[x, 1.0]
            w = now(rows)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    return now(np.arange(n_features + 1))


def fit_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    loss = lambda t: -np.log(softmax(margins / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean()
    lo, hi, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_task("langid")
    df, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            features, _ = ngram_counts(text)
            df[features] += 1
            n += 1
    used = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1]), pa.array(np.r_[df[used], n])], names=["feature", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, langs, texts = batch.columns
        made = [ngram_counts(t) for t in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, langs, *(pa.array([x[i].astype("<u4").tobytes() for x in made], pa.binary()) for i in (0, 1))], names=["doc_id", "lang", "features", "counts"])


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with a text and a language whose crc32(id) modulo 4 is not 2.

    Document frequencies come from all such rows; the weights and the temperature from a sample of about
    ``sample_per_language`` documents a language, one in five of them for the temperature.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(learned_from(id_col)).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    df = rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()
    frequency = np.zeros(1 << BITS)
    known = df[df.feature >= 0]
    frequency[known.feature.to_numpy()] = known.df.to_numpy()
    total = int(df[df.feature < 0].df.sum())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros(((1 << BITS) + 1, 1)))
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample_per_language / counts[lang]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.where(place < F.coalesce(share[F.col("lang")], F.lit(0.0))).mapInArrow(_features, "doc_id long, lang string, features binary, counts binary").toPandas()
    sample = sample.sort_values(["doc_id", "lang"], kind="stable", na_position="first", ignore_index=True)
    model = LanguageModel(languages, idf, np.zeros(((1 << BITS) + 1, len(languages))))
    read = lambda b: np.frombuffer(b, "<u4").astype(np.int64)
    found = [(f := read(a), model.vector(f, read(b))) for a, b in zip(sample.features, sample.counts, strict=True)]
    labels = np.searchsorted(languages, sample.lang.to_numpy(str)) if len(sample) else np.empty(0, int)
    if not len(sample):
        return model
    held = np.arange(len(labels)) % 5 == 4
    train = np.flatnonzero(~held)
    model.weights = train_ftrl([found[i] for i in train], labels[train], 1 << BITS, len(languages))
    if held.any():
        margins = np.stack([x @ model.weights[f] + model.weights[-1] for f, x in (found[i] for i in np.flatnonzero(held))])
        model.temperature = fit_temperature(margins, labels[held])
    return model


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``lang_pred``, ``lang_score`` (0 to 1) of every whole text.

    A null text and one without letters are ``und`` with score 0; so is every text if nothing could be learned. Input
    columns of those two names are replaced. An empty table stays empty.
    """
    from pyspark.sql.functions import pandas_udf

    small_batches(docs.sparkSession)

    @pandas_udf("lang_pred string, lang_score double")
    def predict(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "lang_score"])

    own = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    name = next(c for c in ("_found", "_found_", "__found") if c not in own)
    return docs.withColumn(name, predict(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in own], f"{name}.lang_pred", f"{name}.lang_score")
