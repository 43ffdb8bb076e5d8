"""Embedding near-dedup: int8 tile products with rigorous error bounds, then full precision where needed.

A unit vector x is stored as s * q with int8 q and a scale s; e is the norm of what that leaves out. For two
vectors the true cosine differs from the quantised product by at most e_x * |s_y q_y| + e_y. Codes, scales and errors
are made once. Tiles of two blocks multiply int8 codes (exactly, in slices whose sums float32 holds), add the bound,
and hand on the vectors that have a possible partner; only those come to their tile again, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, key_of, saved, small_batches

THRESHOLD, BLOCK = 0.93, 1024
#: Covers rounding of the bound itself in double precision.
SLACK = 1e-9
#: Dimensions in one float32 product: 127 * 127 * SLICE is below 2 ** 24.
SLICE = 1024


def rescaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, exactly, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of the quantised vectors and of the errors, for the rows of ``x`` made unit length."""
    x = rescaled(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stored = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stored, axis=1), np.linalg.norm(unit - stored, axis=1)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def near(x: Codes, y: Codes, threshold: float) -> np.ndarray:
    """Which pairs of rows of two quantised blocks may have a cosine that reaches the threshold."""
    (qx, sx, nx, ex), (qy, sy, ny, ey) = x, y
    product = np.zeros((len(qx), len(qy)))
    for at in range(0, qx.shape[1], SLICE):
        product += qx[:, at : at + SLICE].astype(np.float32) @ qy[:, at : at + SLICE].astype(np.float32).T
    return product * sx[:, None] * sy + ex[:, None] * ny + ey >= threshold - SLACK


def possible_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs whose cosine may reach the threshold."""
    return np.nonzero(near(quantise(x), quantise(y), threshold))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[int]:
    """Each node's smallest reachable node."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
    return [root(i) for i in range(n)]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quantised vectors; a batch can hold more than one length."""
    for batch in batches:
        rows = batch.to_pandas()
        for _, part in rows.groupby("dim"):
            codes, scale, norm, error = quantise(np.stack(part["x"].to_numpy()).astype(np.float64))
            made = part.drop(columns="x").assign(codes=[q.tobytes() for q in codes], scale=scale, norm=norm, error=error)
            yield pa.RecordBatch.from_pandas(made, preserve_index=False)


def _sides(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of a tile's two blocks, and whether they are one."""
    alone = bool(own.min() == own.max())
    left = np.arange(len(own)) if alone else np.flatnonzero(own == own.min())
    return left, left if alone else np.flatnonzero(own == own.max()), alone


def _with_partners(threshold: float):
    """Rows of one tile that have a possible partner there, by their codes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.stack([np.frombuffer(q, np.int8) for q in rows["codes"]])
        every = (codes, *(rows[c].to_numpy() for c in ("scale", "norm", "error")))
        left, right, alone = _sides(rows["own"].to_numpy())
        ok = near(tuple(a[left] for a in every), tuple(a[right] for a in every), threshold)
        if alone:
            np.fill_diagonal(ok, False)
        has = np.zeros(len(rows), bool)
        has[left] |= ok.any(axis=1)
        has[right] |= ok.any(axis=0)
        return rows.loc[has, ["label", "dim", "lo", "hi", "own", "k", "h", "copies"]]

    return run


def _linked(threshold: float):
    """Of one tile: for each vector how many vectors it is linked with, and a forest of the links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k", ignore_index=True)
        x = rescaled(np.stack(rows["x"].to_numpy()).astype(np.float64))
        own, keys, copies = (rows[c].to_numpy() for c in ("own", "k", "copies"))
        left, right, alone = _sides(own)
        i, j = possible_pairs(x[left], x[right], threshold)
        i, j = left[i], right[j]
        if alone:
            i, j = i[i < j], j[i < j]
        good = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            good[part] = _cosines(x[i[part]], x[j[part]]) >= threshold
        i, j = i[good], j[good]
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        roots = np.array(_forest(len(rows), i, j), np.int64)
        out = pd.DataFrame({"a": keys, "b": keys[roots], "links": links.astype(np.int64)})
        return out[(out.a != out.b) | (out.links > 0)]

    return run


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``k, n_links, component`` of each row: cosines of ``threshold`` and more, within equal labels.

    ``k`` is the id with null as the smallest long. A null, empty or zero vector, one with a null or non-finite
    component, and a null label link with nothing. Vectors of different lengths link with nothing either.
    Equal vectors of a label collapse to one with a count. Every row counts as a vector; rows under one id
    share their links and their component. A label's vectors are dealt to blocks of about ``block``, and each pair of
    blocks is one group of at most about two blocks: the work is all pairs of a label, one byte a dimension. A tile
    returns counts and a forest of its links, never the pairs. An empty table gives none; other columns are ignored.
    """
    small_batches(vectors.sparkSession)
    v = F.col(vector_col)
    doubles = F.transform(v, lambda c: c.cast("double"))
    sound = v.isNotNull() & F.col(label_col).isNotNull() & F.coalesce(F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(doubles, lambda c: c != 0), F.lit(False))
    rows = vectors.select(key_of(id_col).alias("k"), F.when(sound, F.col(label_col).cast("string")).alias("label"), F.when(sound, doubles).alias("x"))
    classes = saved(rows.where("label is not null").groupBy("label", "x").agg(F.min("k").alias("k"), F.count("*").alias("copies")), "classes")
    sized = classes.select("label", F.size("x").alias("dim"), "k", F.xxhash64("x").alias("h"), "copies", "x")
    counts = sized.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    coded = sized.mapInArrow(_coded, "label string, dim int, k long, h long, copies long, codes binary, scale double, norm double, error double")
    tiles = coded.join(counts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("k", "h"), F.col("blocks")).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "blocks")
    place = ["label", "dim", "lo", "hi"]
    rest = saved(tiles.groupBy(place).applyInPandas(_with_partners(threshold), "label string, dim int, lo int, hi int, own int, k long, h long, copies long"), "rest")
    late = rest.join(sized.select("label", "dim", "k", "h", "x"), ["label", "dim", "k", "h"])
    found = saved(late.groupBy(place).applyInPandas(_linked(threshold), "a long, b long, links long"), "found")
    discard(rest)
    members = rows.join(classes.select("label", "x", F.col("k").alias("rep"), "copies"), ["label", "x"], "left").select("k", F.coalesce("rep", "k").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    members = saved(members, "members")
    discard(classes)
    same_id = members.join(members.groupBy("k").agg(F.min("rep").alias("b")), "k").where("rep <> b").select(F.col("rep").alias("a"), "b")
    components = connected_components(found.select("a", "b").where("a <> b").unionByName(same_id)).select(F.col("node").alias("rep"), "component")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    return members.join(links, "rep", "left").join(components, "rep", "left").select("k", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
