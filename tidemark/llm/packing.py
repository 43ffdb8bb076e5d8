"""Packing: first-fit decreasing with a tournament tree of bin capacities, in random groups of documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin_task, small_batches
from .wordbpe import encoder, vocabulary

MAX_TOKENS, END_ID, GROUP_DOCS = 4096, 2, 2048


class CapacityTree:
    """A tournament tree over bins in order of opening; each node holds the largest free capacity below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put an item into the first bin with room for it; returns the bin and the capacity it had."""
        most, at = self.most, 1
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        free, bin_ = most[at], at - self.leaves
        most[at] = free - size
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return bin_, free


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; ``sizes`` must be in descending order and none above ``capacity``."""
    tree, bins, offsets = CapacityTree(len(sizes), capacity), [], []
    for size in sizes:
        bin_, free = tree.place(size)
        bins.append(bin_)
        offsets.append(capacity - free)
    return bins, offsets


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pack every whole text into sequences of at most ``max_tokens`` ids; one row per piece.

    Columns: ``doc_id, start, length, doc_tokens`` (long), ``ids`` (binary, little-endian unsigned 32 bit),
    ``sequence_id, offset`` (long). A document's ids and the end id are cut into full pieces and one
    rest; pieces go to random groups of about ``group_docs`` documents (full pieces on their own, so a very
    long document fills no group), and each group is packed by itself. A row's group follows from its id, its text
    and its input partition, so that rows of one id, or of none, don't share a group. A null text counts as empty: one
    piece with the end id. Rows of equal id are packed separately, repeated rows too, null ids stay null, an empty
    table gives no pieces, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or vocabulary()
    groups = max(1, math.ceil(docs.count() / group_docs))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text, F.spark_partition_id()).alias("salt"), text.cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("wordbpe")
        enc = encoder(path)
        end, wide = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        step = max_tokens * wide
        for batch in batches:
            ids, salts, texts = (c.to_pylist() for c in batch.columns)
            out: list[tuple] = []
            for doc_id, salt, raw in zip(ids, salts, enc.encode_bytes(texts, end), strict=True):
                out += [(doc_id, salt, i // wide, len(part := raw[i : i + step]) // wide, len(raw) // wide, part) for i in range(0, len(raw), step)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "salt", "start", "length", "doc_tokens", "ids"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        dtype = encoder(path).dtype
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), max_tokens)
        wide = [np.frombuffer(x, dtype).astype("<u4").tobytes() for x in table.column("ids").to_pylist()]
        group = table.column("piece_group")[0].as_py()
        made = {"ids": pa.array(wide, pa.binary()), "sequence_id": pa.array(np.array(bins, np.int64) + (group << 32)), "offset": pa.array(offsets, pa.int64())}
        return pa.table({c: table.column(c) for c in ("doc_id", "start", "length", "doc_tokens")} | made)

    schema = "doc_id long, {}start long, length long, doc_tokens long, ids binary"
    alone = F.when(F.col("length") == max_tokens, F.col("start")).otherwise(-1)
    pieces = rows.mapInArrow(cut, schema.format("salt long, ")).withColumn("piece_group", F.pmod(F.xxhash64("salt", alone), F.lit(groups))).drop("salt")
    return pieces.groupBy("piece_group").applyInArrow(pack, schema.format("") + ", sequence_id long, offset long")
