"""Token ids in Arrow files of equal-length sequences.

A file is an Arrow IPC file of record batches with two fixed-size-list columns, ``input_ids`` and
``attention_mask``; a second, small Arrow file lists its documents. A reader maps the file and
gets any sequence, or any run of tokens, as a view without copying.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, saved, shared_dir, small_batches
from .wordbpe import encoder, vocabulary

END_ID, SEQUENCE, BATCH = 2, 1024, 1024
SHARD_BYTES = 48 << 20
#: Most tasks that read files, and ranges of ids whose token sums are added up together.
READERS, SUM_GROUP = 10_000, 1024


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs, name


class ShardWriter:
    """Appends documents' ids to one file; whole batches are written as soon as they are full."""

    def __init__(self, stem: str, dtype: np.dtype, sequence: int = SEQUENCE, batch: int = BATCH) -> None:
        self.stem, self.sequence, self.dtype = stem, sequence, np.dtype(dtype)
        self.step = sequence * batch * self.dtype.itemsize  # bytes in a full batch
        self.fs, name = _open(f"{stem}.ids.arrow")
        self.schema = pa.schema({"input_ids": pa.list_(pa.from_numpy_dtype(self.dtype), sequence), "attention_mask": pa.list_(pa.bool_(), sequence)})
        self.fs.create_dir(name.rpartition("/")[0])
        self.sink = self.fs.open_output_stream(name)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.full = self._mask(sequence * batch, sequence * batch)
        self.waiting: list[bytes] = []
        self.held = self.total = 0
        self.ids: list[int | None] = []
        self.starts: list[int] = []

    def _mask(self, n: int, real: int) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n) < real), self.sequence)

    def _put(self, ids: bytes | memoryview, mask: pa.Array) -> None:
        n = len(ids) // self.dtype.itemsize
        values = pa.Array.from_buffers(pa.from_numpy_dtype(self.dtype), n, [None, pa.py_buffer(ids)])
        self.writer.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(values, self.sequence), mask], schema=self.schema))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document's ids, little-endian and of the file's type."""
        self.ids.append(doc_id)
        self.starts.append(self.total)
        self.total += len(ids) // self.dtype.itemsize
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.step:
            every = memoryview(b"".join(self.waiting))
            done = len(every) // self.step * self.step
            for i in range(0, done, self.step):
                self._put(every[i : i + self.step], self.full)
            self.waiting, self.held = [bytes(every[done:])], len(every) - done

    def close(self) -> None:
        if self.held:
            width = self.sequence * self.dtype.itemsize
            padded = b"".join(self.waiting).ljust(math.ceil(self.held / width) * width, b"\0")
            self._put(padded, self._mask(len(padded) // self.dtype.itemsize, self.held // self.dtype.itemsize))
        self.writer.close()
        self.sink.close()
        lengths = np.diff([*self.starts, self.total])
        table = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "start": pa.array(self.starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})
        _, name = _open(f"{self.stem}.docs.arrow")
        with self.fs.open_output_stream(name) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)


class ShardReader:
    """Random access to one shard."""

    def __init__(self, stem: str) -> None:
        fs, name = _open(f"{stem}.ids.arrow")
        self.source = pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("input_ids").type.list_size
        fs, name = _open(f"{stem}.docs.arrow")
        with fs.open_input_file(name) as source:
            self.docs = pa.ipc.open_file(source).read_all()
        self._at, self._ids = -1, np.empty(0)
        self.step = len(self._batch(0)) if self.file.num_record_batches else 1

    def _batch(self, i: int) -> np.ndarray:
        if i != self._at:
            self._at, self._ids = i, self.file.get_batch(i).column("input_ids").values.to_numpy(zero_copy_only=True)
        return self._ids

    def sequence_ids(self, i: int) -> np.ndarray:
        """Sequence ``i`` as a view of the file."""
        per = self.step // self.sequence
        return self._batch(i // per)[i % per * self.sequence :][: self.sequence]

    def sequence_mask(self, i: int) -> np.ndarray:
        per = self.step // self.sequence
        return self.file.get_batch(i // per).column("attention_mask")[i % per].values.to_numpy(zero_copy_only=False)

    def tokens(self, start: int, n: int) -> list[np.ndarray]:
        """Tokens ``start`` to ``start + n`` of the shard, as views of the batches they lie in."""
        out = []
        while n:
            part = self._batch(start // self.step)[start % self.step :][:n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out


def write_token_files(docs: DataFrame, out_dir: str | None = None, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, sequence: int = SEQUENCE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every whole text and write files in ascending id order; returns the manifest.

    Manifest columns: ``shard`` int and ``part`` int (the file's place), ``stem`` string, ``start`` long (tokens in
    all earlier files), ``n_tokens`` long, ``n_docs`` long. It has one row a file and is itself a table in the shared
    folder; nothing of it passes through the driver. A null text counts as empty and yields the end id alone; null ids
    come first; rows of equal id stay apart, in the order of their texts' hashes, so that an id that many rows have (or
    null) fills as many shards as it needs; repeated rows stay; an empty table gives an empty manifest. A shard is one
    task's range of ids; when a file holds more than ``shard_bytes`` of ids the task goes on in another. Other
    columns are ignored. A task that runs again writes new files under another name, and only those the manifest
    names are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out_dir, path = out_dir or shared_dir(spark, "token-files"), path or vocabulary()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, made = TaskContext.get().partitionId(), None, []
        begin_task("wordbpe")
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()

        def close() -> None:
            writer.close()
            made.append((len(made), writer.stem, writer.total, len(writer.ids)))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_bytes(batch.column(1).to_pylist(), end), strict=True):
                if writer is None:
                    writer = ShardWriter(f"{out_dir}/{shard:06d}-{len(made):04d}-{uuid.uuid4().hex[:12]}", enc.dtype, sequence)
                writer.add(doc_id, ids)
                if writer.total * enc.dtype.itemsize > shard_bytes:
                    close()
                    writer = None
        if writer:
            close()
        part, stem, n_tokens, n_docs = zip(*made, strict=True) if made else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(made), pa.int32()), "part": pa.array(part, pa.int32()), "stem": pa.array(stem, pa.string()), "n_tokens": pa.array(n_tokens, pa.int64()), "n_docs": pa.array(n_docs, pa.int64())})

    dealt = rows.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    files = saved(dealt.mapInArrow(write, "shard int, part int, stem string, n_tokens long, n_docs long"), "token-files-manifest")
    # running sums in two levels: within groups of shards, and over the groups (one short row for each 1024 shards)
    files = files.withColumn("g", F.floor(F.col("shard") / SUM_GROUP))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = files.groupBy("g").agg(F.sum("n_tokens").alias("n_tokens")).select("g", before(Window.orderBy("g")).alias("base"))
    within = files.withColumn("within", before(Window.partitionBy("g").orderBy("shard", "part")))
    return within.join(groups, "g").select("shard", "part", "stem", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "n_docs")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id, start, n_tokens, ids`` (binary, little-endian unsigned 32 bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = ShardReader(row["stem"])
                for part in reader.docs.to_batches(max_chunksize=512):
                    ids, starts, lengths = part.columns
                    tokens = [b"".join(x.astype("<u4").tobytes() for x in reader.tokens(s, n)) for s, n in zip(starts.to_pylist(), lengths.to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(starts.to_numpy() + row["start"]), lengths, pa.array(tokens, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    n = min(max(1, manifest.count()), READERS)
    return manifest.select("stem", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
