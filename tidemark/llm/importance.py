"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

A batch's texts are joined with separators and one regular expression cuts the whole buffer into words with what
follows them; ``searchsorted`` on the documents' offsets tells which n-grams lie within one document. CRC-32 values
of words are taken column by column over all words of a batch, those of n-grams by the linear rule for joined strings,
and buckets are counted with ``bincount``. Spark adds up the buckets of all tasks. The gain of a bucket is its
log ratio between target and corpus, a document's weight the mean of its gains, and perturbed weights (Gumbel noise from
a hash of the id) draw without replacement.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, saved, small_batches

BUCKETS, NGRAM, SEED = 10_000, 2, 7
#: Documents with fewer words are never drawn.
MIN_WORDS = 20
#: Percent of those that are long enough which are drawn.
PERCENT = 25
#: Bytes of text that a task joins at a time; a longer text is a buffer of its own.
BUFFER = 4 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
_WORD_BYTES = bytes(b for b in range(256) if not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
#: A word (of lower-cased bytes) with the separators after it.
_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*")
_IS_WORD = np.zeros(256, np.int32)
_IS_WORD[list(_WORD_BYTES)] = 1
SEPARATOR = b"\n"


@functools.cache
def _byte_table() -> np.ndarray:
    """CRC-32 register changes by the low byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@functools.cache
def _shift_table(power: int) -> np.ndarray:
    """What ``2**power`` zero bytes make of a register, by its four bytes: the map is linear over bits."""
    if power == 0:
        t = _byte_table()
        low = np.arange(256, dtype=np.uint32)
        return np.stack([t, *(low << np.uint32(8 * (i - 1)) for i in (1, 2, 3))])
    half = _shift_table(power - 1)
    return _apply(half, _apply(half, np.arange(256, dtype=np.uint32)[None, :] << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]))


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    b = np.uint32(255)
    return table[0][x & b] ^ table[1][(x >> np.uint32(8)) & b] ^ table[2][(x >> np.uint32(16)) & b] ^ table[3][x >> np.uint32(24)]


def joined_crc(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from the values of both parts and the second part's bytes."""
    a = a.copy()
    for power in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> power & 1)
        a[at] = _apply(_shift_table(power), a[at])
    return a ^ b


def crc_of_words(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes, one byte column after another."""
    table, out = _byte_table(), np.full(len(start), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(length <= LONG_WORD)
    j = 0
    while len(at := at[length[at] > j]):
        r = out[at]
        out[at] = (r >> np.uint32(8)) ^ table[(r ^ buffer[start[at] + j]) & np.uint32(255)]
        j += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = zlib.crc32(buffer[start[i] : start[i] + length[i]])
    return out


def batch_buckets(texts: list[bytes | None], buckets: int = BUCKETS, ngram: int = NGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and of each n-gram of up to ``ngram`` words within a text, its text's place and its bucket."""
    buffer = SEPARATOR.join(t or b"" for t in texts).lower()
    sizes = np.array([len(t or b"") for t in texts], np.int64)
    ends = np.cumsum(sizes + 1)  # a text ends at its separator
    flat = np.frombuffer(buffer, np.uint8)
    is_word = _IS_WORD[flat]
    pieces = _WORDS.findall(buffer)
    if not pieces:
        return np.zeros(len(texts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    steps = np.fromiter(map(len, pieces), np.int64, len(pieces))
    start = len(buffer) - steps.sum() + np.r_[0, np.cumsum(steps[:-1])]
    length = np.add.reduceat(is_word, start).astype(np.int64)
    doc = np.searchsorted(ends, start, "right")
    word = crc_of_words(flat, start, length)
    spaced = joined_crc(word, np.full(len(word), zlib.crc32(b" "), np.uint32), np.ones(len(word), np.int64))
    crc, span, docs, found = word, length, [doc], [word % np.uint32(buckets)]
    for n in range(2, ngram + 1):
        # one more word in front of the (n-1)-grams; those that reach into the next document are masked
        crc = joined_crc(spaced[: len(crc) - 1], crc[1:], span[1:])
        span = length[: len(crc)] + 1 + span[1:]
        inside = doc[: len(crc)] == doc[n - 1 :]
        docs.append(doc[: len(crc)][inside])
        found.append(crc[inside] % np.uint32(buckets))
    return np.bincount(doc, minlength=len(texts)), np.concatenate(docs), np.concatenate(found).astype(np.int64)


def _buffers(texts: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts in groups of about BUFFER bytes."""
    held, size = [], 0
    for t in texts.cast(pa.binary()).to_pylist():
        held.append(t)
        size += len(t or b"")
        if size >= BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM) -> np.ndarray:
    """Features in each bucket over all texts; each task hands on at most ``buckets`` sums."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("importance")
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _buffers(batch.column(0)):
                total += np.bincount(batch_buckets(texts, buckets, ngram)[2], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in target and corpus, rounded down."""
    s, t, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((y + 1) * (s + b)) / ((x + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """All columns of ``docs`` and, last, a struct of ``n_words, n_features, weight`` (the floored mean gain) for each row.

    The struct is called ``_weighed``, with more underscores before it if the input has such a column.
    """
    small_batches(docs.sparkSession)
    buckets = len(gains)

    @F.arrow_udf("n_words long, n_features long, weight long")
    def weighed(texts: pa.Array) -> pa.Array:
        parts = []
        for group in _buffers(texts):
            n_words, doc, bucket = batch_buckets(group, buckets, ngram)
            n = np.bincount(doc, minlength=len(group))
            total = np.zeros(len(group), np.int64)
            np.add.at(total, doc, gains[bucket])
            parts.append((n_words, n, np.where(n > 0, total // np.maximum(n, 1), 0)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
        return pa.StructArray.from_arrays(list(map(pa.array, columns)), names=["n_words", "n_features", "weight"])

    return docs.withColumn(free_name(docs, "_weighed"), weighed(F.col(f"`{text_col}`").cast("string")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, ngram: int = NGRAM, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every row's ``doc_id, n_words, n_features, weight, score, rank`` (the rank of drawn rows; null for the others).

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down) of the highest scores are drawn;
    ties go to the smaller id, null first. Null and empty texts have no feature, weight 0, and are never drawn unless
    ``min_words`` is 0; long texts are read whole. Repeated rows are rows like others: equal in id and text, they score
    alike and follow each other. A null id has the noise of an empty id. An empty table gives none; an empty target has
    counts of zero. Columns other than id and text are ignored, whatever they are called.

    The rank is a sort over ranges of scores with the ranges' sizes added up, so no task sees more than its range; only
    counts by score (at most some hundred thousand, as gains and noise are bounded) meet in one task.
    """
    gains = gains_of(bucket_counts(docs, text_col, buckets, ngram), bucket_counts(target, text_col, buckets, ngram))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296)))
    found = weigh(rows, gains, "text", ngram).select("doc_id", "_weighed.*").withColumn("score", F.col("weight") + gumbel)
    scored = saved(found, "resample-scores")
    fits = scored.where(F.col("n_words") >= min_words)
    by_score = fits.groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    drawn = percent * int(by_score.n.sum()) // 100
    upto = by_score.n.cumsum().to_numpy()
    if not drawn:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = int(by_score.score.to_numpy()[np.searchsorted(upto, drawn)])
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("_spread")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    above = fits.where(F.col("score") >= last).withColumn("_spread", F.rand(seed))
    # the id of a row counts within its range, in its lower 33 bits
    placed = saved(above.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "resample-ranges")
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(before), "_range").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where((F.col("n_words") < min_words) | (F.col("score") < last)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*rest.columns).unionByName(rest)
