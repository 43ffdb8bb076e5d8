"""Exact cosine search in blocks, and diversity-aware selection from its candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Nearest:
    """The ``k`` rows most similar to each of a block of queries (of length one), of all that were added; of equal ones those of smaller ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, places: int) -> None:
        self.ids, self.x, self.k, self.places = ids, x, k, places
        self.best, self.own = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rids: np.ndarray, y: np.ndarray, same: bool = False) -> None:
        """More rows. One with a query's own id does not count for it, unless these are ids of something else (``same``)."""
        s = self.x @ unit(y).T
        # only rows that come before some query's last one can change anything; rounding moves a similarity by half a unit
        last, mine = self.best[:, -1:], self.own[:, -1:]
        at = (s >= last - 10.0**-self.places).any(axis=0)
        s, rids = np.round(s[:, at], self.places), rids[at]
        s[~np.isfinite(s) if same else (self.ids[:, None] == rids) | ~np.isfinite(s)] = -np.inf
        at = ((s > last) | ((s == last) & (rids < mine) & (s > -np.inf))).any(axis=0)
        if at.any():
            every, whose = np.hstack([self.best, s[:, at]]), np.hstack([self.own, np.broadcast_to(rids[at], (len(self.ids), at.sum()))])
            order = np.lexsort((whose, -every), axis=1)[:, : self.k]
            self.best, self.own = np.take_along_axis(every, order, 1), np.take_along_axis(whose, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of queries and of their rows, and the similarities."""
        i, j = np.nonzero(np.isfinite(self.best))
        return self.ids[i], self.own[i, j], self.best[i, j]


def _nearest(rows: DataFrame, queries: list, k: int, places: int) -> DataFrame:
    """``qid, rid, similarity``: the ``k`` rows of each task (``rid, v``) that are most similar to each of a block of queries."""
    ids = np.array([q.qid for q in queries], np.int64)
    x = unit(np.array([q.v for q in queries], float).reshape(len(ids), -1 if len(ids) else 0))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Nearest(ids, x, k, places)
        for whole in batches:
            for batch in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows if len(ids) else 0, BLOCK)):
                rids = batch.column("rid").to_numpy(zero_copy_only=False)
                held.add(rids, batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rids), -1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.found()], ["qid", "rid", "similarity"])

    return rows.select(F.col("rid").cast("long").alias("rid"), "v").mapInArrow(nearest, "qid long, rid long, similarity double")


def cosine_topk(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int, places: int = 9) -> DataFrame:
    """``query_id, row_id, similarity, rank``: the ``k`` most similar other rows of each query.

    Queries of one block go to every task, which passes over its own rows once and returns ``k`` rows a query. More queries
    and the rows are dealt to blocks; each pair of blocks is one bounded group that returns ``k`` rows a query.
    Similarities are rounded so that equal ones tie and the smaller id wins. Null vectors take no part.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("qid"), F.col(vector).alias("v"))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(row_id).alias("rid"), F.col(vector).alias("v"))
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "rid")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("qid").alias(query_id), F.col("rid").alias(row_id), "similarity", "rank")
    nq = max(1, math.ceil(q.count() / BLOCK))
    if nq == 1:
        return ranked(_nearest(r, q.collect(), k, places))  # one block at most
    nr = max(1, math.ceil(r.count() / BLOCK))
    null, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    left = q.select(F.pmod(F.xxhash64("qid"), F.lit(nq)).alias("a"), F.explode(F.sequence(zero, F.lit(nr - 1).cast("long"))).alias("b"), "qid", null.alias("rid"), "v")
    right = r.select(F.explode(F.sequence(zero, F.lit(nq - 1).cast("long"))).alias("a"), F.pmod(F.xxhash64("rid"), F.lit(nr)).alias("b"), null.alias("qid"), "rid", "v")

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf.qid.notna()].sort_values("qid")
        other = pdf[pdf.rid.notna()].sort_values("rid")
        if not len(own) or not len(other):
            return pd.DataFrame({"qid": [], "rid": [], "similarity": []})
        x, y = (np.stack(d.v.to_numpy()).astype(float) for d in (own, other))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        ids, rids = own.qid.to_numpy(np.int64), other.rid.to_numpy(np.int64)
        s = np.round(x @ y.T, places)
        s[ids[:, None] == rids] = -np.inf
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(ids)), top.shape[1])
        out = pd.DataFrame({"qid": ids[i], "rid": rids[top.ravel()], "similarity": s[i, top.ravel()]})
        return out[np.isfinite(out.similarity)]

    part = left.unionByName(right).groupBy("a", "b").applyInPandas(best, "qid long, rid long, similarity double")
    return ranked(part)


def mmr_topk(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, vector: str, k: int = 4, fetch: int | None = None, weight: float = 0.5) -> DataFrame:
    """Greedy picks by ``weight * similarity - (1 - weight) * largest similarity to a pick``, from ``fetch`` candidates."""
    near = cosine_topk(rows, queries, row_id, query_id, vector, fetch or max(3 * k, 12))
    full = near.join(rows.select(row_id, vector), row_id)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        s, sim, chosen = np.round(x @ x.T, 9), pdf.similarity.to_numpy(), [0]
        while len(chosen) < min(k, len(pdf)):
            score = np.round(weight * sim - (1 - weight) * s[:, chosen].max(axis=1), 9)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
        return pd.DataFrame({query_id: pdf[query_id].iloc[0], row_id: pdf[row_id].to_numpy()[chosen], "pick": np.arange(1, len(chosen) + 1)})

    return full.groupBy(query_id).applyInPandas(pick, f"{query_id} long, {row_id} long, pick long")
