"""Toxicity by maximum-scoring segments.

Tokens are words and word beginnings (insults are inflected and joined). They score by their log-odds between
toxic and other documents under an informative Dirichlet prior (the corpus's own token frequencies), drawn towards
zero by a share of their error; a word takes the score of its most telling token, and every score is lowered a
little. A word that stands among the two before it tells nothing new and scores like an unknown one. One pass over a text's scores finds all maximal segments in linear time. Segment scores follow extreme-value
statistics, which sets apart chance runs in long texts; the segments' joint statistic becomes a probability by a
calibration on labels. Chance and calibration come from texts that the odds in use did not see.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task, discard, learned_from, saved, small_batches

#: The classifier is fitted on about this many labelled documents of each class, those with the smallest id hashes.
SAMPLE_PER_CLASS = 8000
DRIFT, PRIOR, CONFIDENCE = 0.2, 50.0, 1.0
#: Odds towards a class need so many texts of that class with the token; else they are zero, as too little is known.
MIN_DOCS = 3
#: The least prior count of a token, that of a token never seen having an error of 1.4.
LEAST_PRIOR = 0.5
#: Lengths of the beginnings that count as tokens, marked by a final hyphen.
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 500_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """A word's tokens, longest first: itself and its beginnings."""
    return [word, *(f"{word[:n]}-" for n in reversed(BEGINNINGS) if len(word) >= n)]


class Memo(dict):
    """What a function gives for each word, kept up to a bound."""

    def __init__(self, of) -> None:  # noqa: ANN001
        super().__init__()
        self.of = of

    def __missing__(self, word: str):  # noqa: ANN204
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.of(word)
        return found

    def __reduce__(self) -> tuple:
        return Memo, (self.of,)


def repeats(words: list[str]) -> np.ndarray:
    """Which words stand among the two words before them: copies in a row are no independent evidence."""
    h = np.fromiter(map(hash, words), np.int64, len(words))
    again = np.zeros(len(words), bool)
    again[1:] |= h[1:] == h[:-1]
    again[2:] |= h[2:] == h[:-2]
    return again


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time (Ruzzo and Tompa)."""
    positive = scores > 0
    if not positive.any():
        return []
    edge = np.flatnonzero(np.diff(np.r_[False, positive, False]))
    sums = np.r_[0.0, np.cumsum(scores)]
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, last one with a smaller sum before
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        before, after, start = sums[a], sums[b], a
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((start, b, before, after, j))
                break
            start, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(after - before)) for a, b, before, after, _ in stack]


@dataclass
class ToxicityModel:
    scores: dict[str, float]
    rate: float  # the exponent of the extreme-value tail
    slope: float = 1.0
    offset: float = 0.0
    drift: float = DRIFT  # by so much the scores are lowered; minus the score of other words

    def gains(self, segments: list[tuple[int, int, float]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Segment scores among ``n`` words, best first, and the joint statistic of the best one, two, ... of them."""
        s = np.sort(np.array([s for *_, s in segments], float))[::-1]
        return s, np.cumsum(self.rate * s - np.log(max(n, 1)) + np.log(np.arange(1, len(s) + 1)))

    def statistic(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Joint extreme-value statistic of the best segments among ``n`` words, however many; higher is less likely by chance."""
        return float(max(self.gains(segments, n)[1].max(initial=0.0), 0.0))

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], list[str]]:
        """Maximal segments of a text as word ranges, and its words."""
        words = tokens_of(text or "")
        if not hasattr(self, "_memo"):
            self._memo = Memo(self.word_score)
        s = np.fromiter(map(self._memo.__getitem__, words), float, len(words))
        s[repeats(words)] = -self.drift
        return maximal_segments(s), words

    def word_score(self, word: str) -> float:
        return max((self.scores[f] for f in features_of(word) if f in self.scores), key=lambda s: abs(s + self.drift), default=-self.drift)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def score(self, text: str | None) -> tuple[float, int, list[str]]:
        """Probability, number and words of the significant passages: those whose joint statistic is the highest.

        Every passage with an expected count by chance below one is among them.
        """
        segments, words = self.passages(text)
        best, total = self.gains(segments, len(words))
        x = self.statistic(segments, len(words))
        bar = best[int(total.argmax())] if x > 0 else np.inf
        found = [" ".join(words[a:b]) for a, b, s in segments if s >= bar]
        return float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40)))), len(found), found


def tail_rate(scores: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of ``sum(chance * exp(rate * score)) = 1``."""
    if not (scores > 0).any():
        return 0.0
    total = lambda r: float(chance @ np.exp(np.minimum(r * scores, 700))) - 1
    lo, hi = 1e-6, 1.0
    while total(hi) < 0 and hi < 1e6:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 0 else (lo, mid)
    return (lo + hi) / 2


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of one statistic, with targets drawn in from 0 and 1, by Newton's method."""
    if not len(x):
        return 0.0, -5.0
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    scale = max(x.std(), 1e-6)
    u, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -40, 40)))
        w -= np.linalg.solve((u * (p * (1 - p))[:, None]).T @ u + 1e-3 * np.eye(2), u.T @ (p - t) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


def tokens_in(words: list[str], of) -> set:  # noqa: ANN001
    """The different tokens of a text's words, from a function of a word."""
    return set().union(*map(of, set(words)))


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class and half that hold a token, counted within the task."""
    begin_task("toxicity")
    counts: dict[tuple[int, int], Counter] = {}
    known = Memo(features_of)
    for batch in batches:
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.setdefault((toxic, half_of(text)), Counter()).update(tokens_in(tokens_of(text), known.__getitem__))
    for (toxic, half), found in counts.items():
        n = len(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([toxic] * n, pa.int64()), pa.array([half] * n, pa.int64()), pa.array(list(found.values()), pa.int64())], names=["word", "toxic", "half", "n"])


def half_of(text: str) -> int:
    """The half, 0 or 1, of the sample that a text is in."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) >> 7 & 1


def shrunk_odds(y1: np.ndarray, y0: np.ndarray, n1: int, n0: int, share: np.ndarray) -> np.ndarray:
    """Log-odds of tokens in ``y1`` of ``n1`` toxic and ``y0`` of ``n0`` other texts, nearer to zero by CONFIDENCE errors.

    They are odds of a toxic text given the token, so that tokens of nearly all texts are near zero in either class.
    """
    prior = np.clip(PRIOR * share, LEAST_PRIOR, PRIOR / 2)
    part = lambda y, m: np.log((y + prior) / (m + PRIOR))
    delta = part(y1, n1) - part(y0, n0)
    return np.sign(delta) * np.maximum(np.abs(delta) - CONFIDENCE * np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior)), 0)


def _corpus_counts(lexicon: set[str]):
    """Texts that hold each token, and under the empty token all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("toxicity")
        counts: Counter = Counter()
        known = Memo(lambda w: tuple(f for f in features_of(w) if f in lexicon))
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_in(tokens_of(text), known.__getitem__))
            counts[""] += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from labels of rows whose crc32(id) modulo 4 is not 2.

    The tokens' odds, the chance of each score and the calibration come from a sample of about ``sample_per_class``
    labelled documents a class, copies of a text counted once; the prior from the share of all documents that hold a
    token. Every token of the sample whose odds are not zero is kept. Null ids and null labels are left out, and of
    several labels of one id the higher holds; long texts are read whole. Without labels of both classes, or without a
    labelled document, every text scores the same.
    """
    small_batches(docs.sparkSession)
    known = labels.where(learned_from(id_col)).select(F.col(id_col).alias("doc_id"), (F.col(label_col) > 0).cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel({}, 0.0, 0.0, -5.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample_per_class / n[1])).otherwise(min(1.0, sample_per_class / n[0]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30) < share)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # about 2 * sample_per_class short rows are broadcast; the sample is read several times, so it is saved
    sample = saved(texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    words = sample.select("text", F.col("toxic").cast("long")).mapInArrow(_words_of, "word string, toxic long, half long, n long")
    n_of = lambda *c: F.sum(math.prod((F.col(x) for x in c), start=F.col("n")))
    words = words.groupBy("word").agg(n_of("toxic").alias("t"), n_of().alias("docs"), n_of("toxic", "half").alias("t1"), n_of("half").alias("docs1")).where((F.col("t") >= MIN_DOCS) | (F.col("docs") - F.col("t") >= MIN_DOCS))

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(map(half_of, texts)), pa.int32()), pa.array(toxic, pa.int32())], names=["half", "toxic"])

    size = {(r.half, r.toxic): r["count"] for r in sample.select("text", "toxic").mapInArrow(sizes, "half int, toxic int").groupBy("half", "toxic").count().collect()}
    of = lambda toxic, *halves: sum(size.get((h, toxic), 0) for h in halves)
    n1, n0 = max(of(1, 0, 1), 1), max(of(0, 0, 1), 1)
    picked = words.toPandas()  # bounded by the sample
    corpus = dict(texts.select("text").mapInArrow(_corpus_counts(set(picked.word)), "word string, n long").groupBy("word").agg(F.sum("n")).collect())
    texts_n = max(corpus.pop("", 0), 1)
    share_of_texts = np.array([corpus.get(w, 0) / texts_n for w in picked.word])

    def learned(y1: np.ndarray, docs_in: np.ndarray, toxic_n: int, other_n: int) -> ToxicityModel:
        score = shrunk_odds(y1.astype(float), (docs_in - y1).astype(float), max(toxic_n, 1), max(other_n, 1), share_of_texts)
        score[np.where(score > 0, y1, docs_in - y1) < MIN_DOCS] = 0
        return ToxicityModel({w: float(s) for w, s in zip(picked.word, score, strict=True) if s}, 0.0, drift=0.0)

    y1, docs_in, y1_1, docs_1 = (picked[c].to_numpy() for c in ("t", "docs", "t1", "docs1"))
    model = learned(y1, docs_in, n1, n0)
    # halves[h] scores the texts of half h by the odds of the other half
    halves = [learned(y1_1, docs_1, of(1, 1), of(0, 1)), learned(y1 - y1_1, docs_in - docs_1, of(1, 0), of(0, 0))]

    def chances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        memos = [Memo(lambda w, m=m: round(m.word_score(w), 2)) for m in halves]
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = tokens_of(text)
                again = repeats(words)
                found.update(map(memos[half_of(text)].__getitem__, (w for w, x in zip(words, again.tolist(), strict=True) if not x)))
                found[0.0] += int(again.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.float64()), pa.array(list(found.values()), pa.int64())], names=["s", "n"])

    seen = sample.where("toxic = 0").select("text").mapInArrow(chances, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    # and half an occurrence of the highest score, which no such text may hold
    s = np.r_[seen.s.to_numpy(float), max(model.scores.values(), default=0.0)]
    chance = np.r_[seen.n.to_numpy(float), 0.5]
    chance /= chance.sum()
    drift = DRIFT + max(float(chance @ s), 0.0)  # below zero on average
    rate = tail_rate(s - drift, chance)
    for m in (model, *halves):
        m.drift, m.rate, m.scores = drift, rate, {w: x - drift for w, x in m.scores.items()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [halves[half_of(t)].statistic(*((seg := halves[half_of(t)].passages(t))[0], len(seg[1]))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1)], names=["x", "toxic"])

    fitted = sample.select("text", "toxic").mapInArrow(measure, "x double, toxic int").toPandas()
    model.slope, model.offset = _fit_line(fitted.x.to_numpy(), fitted.toxic.to_numpy())
    discard(sample)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1), ``toxic_passages`` (array of the passages' words).

    Null and empty texts have no segment and get the score of a text without any; long texts are scored whole;
    repeated rows stay and score alike. Input columns of those two names are replaced. An empty table stays empty.
    """
    from pyspark.sql.functions import pandas_udf

    small_batches(docs.sparkSession)

    @pandas_udf("toxicity double, toxic_passages array<string>")
    def score(texts):  # noqa: ANN001, ANN202
        import pandas as pd

        found = [model.score(t) for t in texts]
        return pd.DataFrame({"toxicity": [f[0] for f in found], "toxic_passages": [f[2] for f in found]})

    own = [c for c in docs.columns if c not in ("toxicity", "toxic_passages")]
    name = next(c for c in ("_found", "_found_", "__found") if c not in own)
    return docs.withColumn(name, score(F.col(f"`{text_col}`"))).select(*[F.col(f"`{c}`") for c in own], f"{name}.toxicity", f"{name}.toxic_passages")
