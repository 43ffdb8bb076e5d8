"""A keyed table of texts and their vectors, changed by snapshots.

Rows lie in buckets by key. A change writes the touched buckets anew, beside the old files, and then a manifest that says which
version of each bucket holds; the manifest of greatest number is the table. Readers of an older one are not disturbed, a
change that fails leaves no trace in the table, and of two changes at once the second one's manifest exists already: it fails.
Vectors are made for new and changed rows only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.embedding import embed
from ..operators.vector import cosine_topk
from .commits import Commits
from .scratch import delete, exists, saved

BUCKETS = 64


class VectorTable:
    """Columns: the key, ``text``, ``metadata`` (a map of strings), ``embedding``, and a digest of text and metadata."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", embedder: Callable[[list[str]], np.ndarray] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.key, self.embedder, self.buckets = spark, path.rstrip("/"), key, embedder, buckets
        self.commits = Commits(spark, f"{self.path}/manifests")

    def version(self) -> int:
        """The number of the newest snapshot, 0 for none."""
        return self.commits.newest()

    def _manifest(self, version: int) -> dict:
        return self.commits.read(version) if version else {"schema": None, "buckets": {}}

    # reading

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a snapshot (the newest), or None if there is none."""
        manifest = self._manifest(self.version() if version is None else version)
        return self._rows(manifest, manifest["buckets"]) if manifest["schema"] else None

    def _rows(self, manifest: dict, buckets) -> DataFrame:  # noqa: ANN001
        paths = [f"{self.path}/data/{manifest['buckets'][b]}/_b={b}" for b in buckets if b in manifest["buckets"]]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    def search(self, queries: DataFrame, query_id: str, text: str, k: int = 4) -> DataFrame:
        """``query_id, key, similarity, rank`` of the ``k`` nearest rows of each query text; keys and query ids are longs."""
        rows = self.read()
        if rows is None:
            return self.spark.createDataFrame([], f"{query_id} long, {self.key} long, similarity double, rank int")
        asked = embed(queries.select(F.col(query_id).alias("_own"), text), text, "embedding", self.embedder)
        # rows and queries are different things, so no row is left out for having a query's id
        found = cosine_topk(rows.select((F.col(self.key) * 2).alias("_row"), "embedding"), asked.select((F.col("_own") * 2 + 1).alias("_query"), "embedding"), "_row", "_query", "embedding", k)
        return found.select(((F.col("_query") - 1) / 2).cast("long").alias(query_id), (F.col("_row") / 2).cast("long").alias(self.key), "similarity", "rank")

    # writing

    def upsert(self, rows: DataFrame, text: str = "text", metadata: str | None = None) -> dict[str, int]:
        """Insert or replace by key; returns how many rows were ``inserted``, ``updated`` and ``unchanged``.

        Rows without a key are left out; of several rows with one key the one of greatest text stays. Rows that are there already with the same
        text and metadata are not embedded or written again; without a change there is no new snapshot.
        """
        spark, key = self.spark, self.key
        version = self.version()
        manifest = self._manifest(version)
        meta = F.coalesce(F.col(metadata), F.create_map().cast("map<string,string>")) if metadata else F.create_map().cast("map<string,string>")
        given = rows.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), meta.alias("metadata"))
        digest = F.sha2(F.concat_ws("\n", "text", F.to_json(F.array_sort(F.map_entries("metadata")))), 256)
        given = given.withColumn("digest", digest).withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("text"), "digest"))).where("_rn = 1").drop("_rn")
        held = self._rows(manifest, manifest["buckets"]).select(key, F.col("digest").alias("_held")) if manifest["schema"] else spark.createDataFrame([], given.select(key).schema.add("_held", "string"))
        kind = F.when(F.col("_held").isNull(), "inserted").when(F.col("_held") == F.col("digest"), "unchanged").otherwise("updated")
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        marked = saved(given.join(held, key, "left").select(*given.columns, kind.alias("_kind"), bucket.alias("_b")), "upsert")
        counts = {k: 0 for k in ("inserted", "updated", "unchanged")} | {r._kind: r["count"] for r in marked.groupBy("_kind").count().collect()}
        fresh = marked.where("_kind <> 'unchanged'")
        touched = sorted(r._b for r in fresh.select("_b").distinct().collect())  # at most ``buckets`` numbers
        if touched:
            made = embed(fresh, "text", "embedding", self.embedder).select(key, "text", "metadata", "digest", "embedding", "_b")
            if manifest["schema"]:
                rest = self._rows(manifest, map(str, touched)).join(fresh.select(key), key, "left_anti")
                made = made.unionByName(rest.withColumn("_b", bucket))
            target = f"{self.path}/data/{version + 1}"
            if exists(spark, target):  # left by a change that failed before its manifest
                delete(spark, target)
            made.repartition("_b").write.partitionBy("_b").parquet(target)
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.drop("_b").schema)
            self.commits.add(version + 1, {"schema": schema, "buckets": manifest["buckets"] | {str(b): version + 1 for b in touched}})
        delete(spark, marked.saved_path)
        return counts

    def reset(self) -> None:
        """Drop all snapshots."""
        if exists(self.spark, self.path):
            delete(self.spark, self.path)
