"""Substring dedup by recompression.

Every text is a sequence of word symbols. A round names maximal runs of one symbol and then pairs of
neighbours whose symbols fall on the left and right side of a split of the alphabet. Names are hashes of
what they stand for, so that all tasks give the same run or pair the same name without a dictionary, and
equal substrings get equal symbols except near their ends. Each symbol also knows the words that decide it
(its context). Spark then groups the high-level symbols: a window of words that holds a symbol, context
included, which occurs once cannot be a repeat. Only windows without such a symbol are hashed whole (128
bits) and grouped, which confirms each repeat and finds its first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, key_of, mix64, release, saved, small_batches, word_hashes

WINDOW = 20
#: On 25 million words of 47,000 texts, 4 rounds left 0.7 million windows to hash that don't repeat, 5 rounds 2.4 million.
ROUNDS = 4
FAR = 1 << 40
#: Words that a task holds before it hands on what it has found.
CHUNK_WORDS = 1_000_000
U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def compress(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds over concatenated documents, with the first and last+1 word that decides each.

    ``doc`` tells documents apart; at their ends a context reaches out of sight (``-FAR`` or ``FAR``).
    """
    symbol, first, last = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    for r in range(rounds):
        joined = doc[1:] == doc[:-1]
        if r == 0:
            head = np.flatnonzero(np.r_[True, ~(joined & (symbol[1:] == symbol[:-1]))])
            tail = np.r_[head[1:] - 1, len(symbol) - 1]
            before = np.where(np.r_[False, joined][head], np.r_[-FAR, first[:-1]][head], -FAR)
            after = np.where(np.r_[joined, False][tail], np.r_[last[1:], FAR][tail], FAR)
            n = (tail - head + 1).astype(U)
            symbol = np.where(n > 1, mix64(symbol[head] * U(3) + n), symbol[head])
            first, last, doc = before, after, doc[head]
            joined = doc[1:] == doc[:-1]
        right = (mix64(symbol + U(7919 * r + 1)) >> U(17)) & U(1) == 1
        to_next, to_prior = np.r_[joined, False], np.r_[False, joined]
        pair = ~right & to_next & np.r_[right[1:], False]
        second = np.r_[False, pair[:-1]]
        # a symbol left alone is so because of the neighbour on its open side; at a text's end that one is unknown
        open_next, open_prior = pair | ~right, ~second & right
        next_first, next_last = (np.where(to_next, np.r_[x[1:], 0], end) for x, end in ((first, -FAR), (last, FAR)))
        prior_first, prior_last = (np.where(to_prior, np.r_[0, x[:-1]], end) for x, end in ((first, -FAR), (last, FAR)))
        new_first = np.where(open_next, np.minimum(first, next_first), np.where(open_prior, np.minimum(first, prior_first), first))
        new_last = np.where(open_next, np.maximum(last, next_last), np.where(open_prior, np.maximum(last, prior_last), last))
        next_symbol = np.r_[symbol[1:], U(0)]
        symbol = np.where(pair, mix64(symbol * U(5) + mix64(next_symbol)), symbol)
        symbol, first, last, doc = (x[~second] for x in (symbol, new_first, new_last, doc))
    return symbol, first, last


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of words that begins at ``starts``."""
    other = mix64(words ^ _B)
    a, b = np.zeros(len(starts), U), np.zeros(len(starts), U)
    for j in range(window):
        a = a * _A + words[starts + j]
        b = b * _B + other[starts + j]
    return mix64(a), mix64(b)


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, np.minimum(starts, n), 1)
    np.add.at(delta, np.minimum(starts + lengths, n), -1)
    return np.cumsum(delta[:-1]) > 0


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[list], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of many batches together: their columns, their words' hashes, each word's row, each row's first word."""
    begin_task("recompress")
    held: list[list] = []
    words: list[np.ndarray] = []
    n = 0

    def chunk():
        sizes = np.array([len(w) for w in words])
        return list(map(list, zip(*held, strict=True))), np.concatenate(words), np.repeat(np.arange(len(words)), sizes), np.r_[0, np.cumsum(sizes)]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.append(row[:-1])
            words.append(word_hashes(row[-1]))
            n += len(words[-1])
            if n >= CHUNK_WORDS:
                yield chunk()
                held, words, n = [], [], 0
    if n:
        yield chunk()


_SYMBOL = ["symbol", "th", "pos", "known"]


def _symbols(rounds: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for (hashes,), words, doc, start in _chunks(batches):
            symbol, first, last = compress(words, doc, rounds)
            of = doc[np.clip(first, 0, len(words) - 1)]
            hashes = np.array(hashes, np.int64)
            fresh = np.array([not (h in seen or seen.add(h)) for h in hashes.tolist()])
            use = (last - first <= window) & (first >= 0)
            use &= fresh[of]
            symbol, first, last, of = symbol[use], first[use], last[use], of[use]
            # what this chunk has twice is known to be shared; one of its places still tells the other chunks
            order = np.lexsort((first, symbol))
            symbol, first, of = symbol[order], first[order], of[order]
            head = np.r_[True, symbol[1:] != symbol[:-1]][: len(symbol)]
            known = ~head | ~np.r_[head[1:], True][: len(symbol)]
            pos = (first - start[of]).astype(np.int32)
            tell = np.flatnonzero(head)
            nothing = pa.nulls(len(tell), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(symbol[tell].view(np.int64)), pa.array(hashes[of[tell]]), pa.array(pos[tell]), nothing], names=_SYMBOL)
            mine = np.flatnonzero(known)
            mine = mine[np.argsort(of[mine], kind="stable")]
            if len(mine):
                new = np.flatnonzero(np.r_[True, np.diff(of[mine]) != 0])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(mine)].astype(np.int32)), pa.array(pos[mine]))
                own = hashes[of[mine[new]]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(own), pa.array(np.zeros(len(new), np.int32)), lists], names=_SYMBOL)

    return run


def _candidates(rounds: int, window: int):
    """Windows that hold no symbol known to be single, hashed; one row for each first place within the chunk.

    ``at`` is the place's word, shifted by 32 bits, and below it 0 for a window that other chunks may have earlier, or
    the number of windows in a row that have an earlier place in this very chunk and need no look at others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (keys, hashes, shared, *_), words, doc, start in _chunks(batches):
            n = len(words)
            if n < window:
                continue
            _, first, last = compress(words, doc, rounds)
            use = (last - first <= window) & (first >= 0)
            first, last = first[use], last[use]
            at = np.zeros(n, bool)
            known = np.concatenate([np.asarray(s, np.int64) + start[i] for i, s in enumerate(shared) if s] or [np.empty(0, np.int64)])
            at[known] = True
            single = ~at[first]
            # windows from last - window to first hold the symbol
            clear = _covered(n, np.maximum(last[single] - window, 0), np.minimum(first[single] - np.maximum(last[single] - window, 0) + 1, n))
            can = ~clear
            can[max(0, n - window + 1) :] = False
            can[: n - window + 1] &= doc[: n - window + 1] == doc[window - 1 :]
            starts = np.flatnonzero(can)
            a, b = window_hashes(words, starts, window)
            keys, hashes = np.array(keys, np.int64), np.array(hashes, np.int64)
            of = doc[starts]
            pos = starts - start[of]
            order = np.lexsort((pos, keys[of], b, a))
            head = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])][: len(order)]
            group = np.cumsum(head) - 1
            lead = order[head][group]
            later = np.zeros(len(starts), bool)
            later[order] = (keys[of[order]] != keys[of[lead]]) | (pos[order] != pos[lead])
            keep = np.zeros(len(starts), bool)
            keep[order[head]] = True
            # a row that shares key and place with the first (a repeated row) is as first as it is
            tied = np.zeros(len(starts), bool)
            tied[order] = ~head
            keep |= tied & ~later
            place = pos.astype(np.int64) << 32
            one = lambda m: [pa.array(keys[of[m]]), pa.array(hashes[of[m]])]
            yield pa.RecordBatch.from_arrays([*one(keep), pa.array(place[keep]), pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], names=_FOUND)
            sure = np.flatnonzero(later)
            if len(sure):
                new = np.flatnonzero(np.r_[True, (np.diff(starts[sure]) != 1) | (np.diff(of[sure]) != 0)])
                size, cut = np.diff(np.r_[new, len(sure)]), sure[new]
                head = starts[cut]
                yield pa.RecordBatch.from_arrays([*one(cut), pa.array(place[cut] + size), pa.array(mix64(a[cut] + mix64(head.astype(U))).view(np.int64)), pa.array(head.astype(np.int64))], names=_FOUND)

    return run


_FOUND = ["k", "th", "at", "a", "b"]


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("recompress")
        for batch in batches:
            original, ranges, rest, texts = batch.columns
            kept, n_words, n_removed = [], [], []
            cuts, at = ranges.offsets.to_numpy(), ranges.values.to_numpy()
            for i, (own, text) in enumerate(zip(original.to_pylist(), texts.to_pylist(), strict=True)):
                words = text.split()
                n = len(words)
                found = at[cuts[i] : cuts[i + 1]]
                if own and not len(found):
                    gone = np.zeros(n, bool)
                else:
                    gone = _covered(n, found >> 32, np.maximum(found & 0xFFFFFFFF, 1) + window - 1) if own else np.full(n, n >= window)
                if gone.any():
                    words = [words[i] for i in np.flatnonzero(~gone)]
                kept.append(b" ".join(words).decode())
                n_words.append(n)
                n_removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays([rest, texts, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["rest", "t", "n_words", "n_removed", "kept_text"])

    return run


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, rest: Column, window: int, rounds: int) -> DataFrame:
    """``rest, t`` (the text's bytes), ``n_words, n_removed, kept_text`` for each row; ``rest`` is a struct.

    Copies of a text are told by the hash of the text and leave the work at once: each of their windows starts
    earlier in the first copy. A hot symbol or window reaches its group once from each chunk of a task, as
    repeats inside a chunk are settled there. Texts are dealt once, by id and hash, and both the search for
    candidates and the removal read that exchange (so both ask for the same columns).
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(key_of(id_col).alias("k"), F.xxhash64(text).alias("th"), rest.alias("rest"), text.cast("binary").alias("t"))
    symbols = rows.select("th", "t").mapInArrow(_symbols(rounds, window), "symbol long, th long, pos int, known array<int>")
    same = Window.partitionBy("symbol", F.col("known").isNull())
    symbols = symbols.withColumns({"lo": F.min("th").over(same), "hi": F.max("th").over(same)}).where("known is not null or lo <> hi")
    places = symbols.groupBy("th").agg(F.array_distinct(F.concat(F.collect_list(F.when(F.col("known").isNull(), F.col("pos"))), F.flatten(F.collect_list("known")))).alias("shared"))
    firsts = rows.groupBy("th", F.md5("t").alias("m")).agg(F.min("k").alias("k")).select("k", "th")
    originals = saved(firsts.join(places, "th", "left").select("k", "th", F.coalesce("shared", F.array().cast("array<int>")).alias("shared")), "originals")
    release(spark)

    found = rows.join(originals, ["k", "th"]).select("k", "th", "shared", "rest", "t").mapInArrow(_candidates(rounds, window), "k long, th long, at long, a long, b long")
    place = F.struct("k", "at")
    first = F.min(place).over(Window.partitionBy("a", "b"))
    sure = F.col("at").bitwiseAND(0xFFFFFFFF) > 0
    repeats = found.withColumn("first", first).where(sure | (place > F.col("first"))).groupBy("k", "th").agg(F.collect_list("at").alias("ranges"))
    result = originals.select("k", "th", F.lit(True).alias("own")).join(repeats, ["k", "th"], "left")
    cut = rows.join(result, ["k", "th"], "left").select(F.coalesce("own", F.lit(False)).alias("own"), F.coalesce("ranges", F.array().cast("array<long>")).alias("ranges"), "rest", "t")
    schema = rows.select("rest", "t").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return cut.mapInArrow(_removed(window), schema)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Remove words that repeated windows cover; ``k, n_words, n_removed, kept_text`` for each row.

    ``k`` is the id with null as the smallest long. A window of ``window`` words whose words also start at an earlier
    place (smaller id, or same id and earlier word) is removed; what is kept is joined by single spaces. Null and empty
    texts have no words; texts shorter than the window stay whole; long texts are never cut. Repeated rows (same id and
    text) are one document and get the same result; different texts under one id are ordered by their places alone. An
    empty table gives none; other columns are ignored.
    """
    found = _deduplicated(docs, id_col, text_col, F.struct(key_of(id_col).alias("k")), window, rounds)
    return found.select("rest.k", "n_words", "n_removed", "kept_text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the words that :func:`dedup_substrings` removes taken out of the texts; a text that loses all goes.

    A text that loses nothing stays as it is, with its white space; null, empty and short texts stay. All columns keep
    their names, order and values, whatever they are called, but for the text.
    """
    rest = F.struct(F.col(text_col).isNull().alias("none"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("others"))
    found = _deduplicated(docs, id_col, text_col, rest, window, rounds).where("n_removed = 0 or kept_text <> ''")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).when(~F.col("rest.none"), F.col("t").cast("string"))
    return found.select(*[text.alias(c) if c == text_col else F.col("rest.others").getField(c).alias(c) for c in docs.columns])
