"""Text embeddings: any function of a list of texts, by default hashed term frequencies that need no model."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import saved
from .text import piece_spans
from .vector import BLOCK, Nearest, unit

DIM = 256
#: Texts that an embedder gets at a time.
BATCH = 256
#: Queries that one pass over texts answers at most, numbers of pieces that a text has, and characters that a task cuts at a time.
QUERIES, PIECES, JOINED = 16_384, 100_000, 500_000
#: Bytes of texts in a task for a block of queries, about, by Spark's own statistics, and the most tasks that these give.
PART_BYTES, MAX_PARTS = 4 << 20, 10_000


#: What every byte of a lower-case text is read as: letters and digits as they are, all others as spaces.
_SPACES = bytes(i if chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for i in range(256))


def _spaced(low: str) -> tuple[bytes, bytes]:
    """A text in UTF-8, and with spaces for all bytes that are in no token."""
    coded = low.encode("utf-8", "surrogatepass")
    return coded, coded.translate(_SPACES)


class _Places(dict):
    """Each token's place, doubled, and its sign in the last bit (1: minus)."""

    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        h = hashlib.md5(token, usedforsecurity=False).hexdigest()
        found = self[token] = int(h[:8], 16) % self.dim * 2 + (h[8] >= "8")
        return found


class HashedTerms:
    """Signed term frequencies in ``dim`` places, of length one (or zero without a token).

    A token's place is the first 32 bits of its MD5 modulo ``dim``, its sign the next bit, so SQL can make the same vectors.
    """

    def __init__(self, dim: int = DIM) -> None:
        self.dim, self.known = dim, _Places(dim)

    def _codes(self, spaced: bytes) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known.clear()
        return np.array([*map(self.known.__getitem__, spaced.split())], np.int64)

    def _vectors(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(counts)), counts)
        out = np.bincount(row * self.dim + (codes >> 1), 1.0 - 2 * (codes & 1), len(counts) * self.dim).reshape(-1, self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    def __call__(self, texts: list[str]) -> np.ndarray:
        codes = [self._codes(_spaced(t.lower())[1]) for t in texts]
        return self._vectors(np.concatenate([*codes, np.zeros(0, np.int64)]), np.array([len(c) for c in codes], np.int64))

    def spans(self, text: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vectors of the stretches of one text from ``begins`` to ``ends``; its tokens are looked up once."""
        low = text.lower()
        if len(low) != len(text):  # a character has become two
            return self([text[a:b] for a, b in zip(begins, ends, strict=True)])
        coded, spaced = _spaced(low)
        inside = np.append(np.frombuffer(spaced, np.uint8) != 32, False)
        first = np.flatnonzero(inside & ~np.append(False, inside[:-1]))
        a, b = begins, ends
        if len(coded) != len(low):  # from characters to bytes
            at = np.append(np.flatnonzero((np.frombuffer(coded, np.uint8) & 0xC0) != 0x80), len(coded))
            a, b = at[begins], at[ends]
        low, high = np.searchsorted(first, a), np.searchsorted(first, b)
        n = high - low
        of = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = self._vectors(self._codes(spaced)[of], n)
        within = lambda x: (x > 0) & inside[x] & inside[x - 1]
        cut = np.flatnonzero(within(a) | within(b))
        if len(cut):
            out[cut] = self([text[begins[i] : ends[i]] for i in cut])
        return out

    def __reduce__(self) -> tuple:
        return HashedTerms, (self.dim,)


def _vectors(embedder: Callable[[list[str]], np.ndarray], texts: list[str]) -> np.ndarray:
    return np.concatenate([np.asarray(embedder(texts[i : i + BATCH]), float) for i in range(0, len(texts), BATCH)])


def embed(df: DataFrame, text: str, out: str = "embedding", embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``df`` with ``out``, the vector of each text; null texts count as empty. The embedder goes to the tasks, so it must pickle."""
    embedder = embedder or HashedTerms()

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts, parts = [t or "" for t in batch.to_pylist()], []
            for i in range(0, len(texts), BATCH):
                m = np.asarray(embedder(texts[i : i + BATCH]), float)
                parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(out, vectors(F.col(f"`{text}`").cast("string")))


def piece_search(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, text: str, sizes: dict[int, int], k: int, vector: str = "embedding", embedder: Callable[[list[str]], np.ndarray] | None = None, places: int = 9) -> tuple[DataFrame, DataFrame]:
    """``size, query_id, chunk_id, similarity, rank``, the ``k`` most similar pieces of each size for each query, and ``size, n_chunks``.

    Sizes come with their overlaps; ``chunk_id`` is ``PIECES * doc_id`` and the piece's number. One pass over the texts, dealt by id,
    answers up to QUERIES queries: a task cuts its texts, makes vectors of BLOCK pieces at a time and hands on ``k`` rows a query, so
    that neither pieces nor vectors are shuffled or written. An embedder with ``spans`` gets a stretch of text and where its pieces lie.
    Similarities are rounded so that equal ones tie and the smaller id wins.
    """
    embedder = embedder or HashedTerms()
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    n_asked, cores = asked.count(), docs.sparkSession.sparkContext.defaultParallelism
    passes = max(1, math.ceil(n_asked / QUERIES))
    # a part has more texts where each hands on rows for more queries
    parts = max(cores, math.ceil(int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / (PART_BYTES * max(1, n_asked / BLOCK))))
    dealt = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))
    dealt = dealt.repartition(parts, "d") if parts <= MAX_PARTS else dealt.repartition("d")  # a size that is not known is very large

    def found(number: int) -> DataFrame:
        block = asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).toArrow()
        ids = block["qid"].to_numpy()
        x = unit(pc.list_flatten(block["v"]).to_numpy().astype(float).reshape(len(ids), -1 if len(ids) else 0))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {s: [Nearest(ids[i : i + BLOCK], x[i : i + BLOCK], k, places) for i in range(0, len(ids), BLOCK)] for s in sizes}
            n = dict.fromkeys(sizes, 0)
            for joined, size, rid, begin, end in _pieces(batches, sizes):
                for i in range(0, len(rid), BLOCK):
                    of, r, a, b = (c[i : i + BLOCK] for c in (size, rid, begin, end))
                    v = _span_vectors(embedder, joined, a, b) if len(ids) else None
                    for s in sizes:
                        mine = of == s
                        n[s] += int(mine.sum())
                        for near in held[s] if mine.any() else []:
                            near.add(r[mine], v[mine], same=True)
            for s in sizes:
                rows = [([None], [None], [None], [n[s]])] + [(*near.found(), None) for near in held[s]]
                for q, r, similarity, count in rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c if c is not None else [None] * len(q), t) for c, t in (([s] * len(q), pa.int32()), (q, pa.int64()), (r, pa.int64()), (similarity, pa.float64()), (count, pa.int64()))], ["size", "qid", "rid", "similarity", "n"])

        part = dealt.mapInArrow(search, "size int, qid long, rid long, similarity double, n long")
        return part if number == 0 else part.where("n is null")  # every pass counts

    made = saved(functools.reduce(DataFrame.unionByName, map(found, range(passes))), "pieces")
    w = Window.partitionBy("size", "qid").orderBy(F.desc("similarity"), "rid")
    ranked = made.where("n is null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    near = ranked.select("size", F.col("qid").alias(query_id), F.col("rid").alias("chunk_id"), "similarity", "rank")
    return near, made.where("n is not null").groupBy("size").agg(F.sum("n").alias("n_chunks"))


def _span_vectors(embedder: Callable[[list[str]], np.ndarray], text: str, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors of stretches of a text, in the order of where they begin."""
    if not hasattr(embedder, "spans"):
        return _vectors(embedder, [text[a:b] for a, b in zip(begins, ends, strict=True)])
    low = int(begins[0])
    return embedder.spans(text[low : int(ends.max())], begins - low, ends - low)


def _pieces(batches: Iterator[pa.RecordBatch], sizes: dict[int, int]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts (``d, t``) joined, and their pieces by where they begin: size, id, begin and end."""
    texts, rows, at = [], [], 0

    def made() -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begin, end, size, rid = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        return "\n".join(texts), size, rid, begin, end

    for batch in batches:
        for d, t in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), strict=True):
            if not t:
                continue
            for s, overlap in sizes.items():
                rows += [(a + at, b + at, s, d * PIECES + i) for i, (a, b) in enumerate(piece_spans(t, s, overlap))]
            texts.append(t)
            at += len(t) + 1
            if at >= JOINED:
                yield made()
                texts, rows, at = [], [], 0
    if texts:
        yield made()
