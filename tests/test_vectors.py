"""Embeddings and the keyed vector table."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.embedding import HashedTerms, embed
from tidemark.sources import writers
from tidemark.sources.vectors import VectorTable

SCHEMA = "chunk_id long, text string, m map<string,string>"
TEXTS = ["insulin dose before a meal", "walking after a meal", "", "stress and sleep", "insulin and stress"]


def rows(spark, *items):
    return spark.createDataFrame([(i, t, {"topic": "x"}) for i, t in items], SCHEMA)


def plain_vector(text, dim):
    v = [0.0] * dim
    for w in re.findall("[a-z0-9]+", (text or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if h[8] < "8" else -1
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm if norm else 0.0 for x in v]


def test_hashed_vectors(spark):
    texts = [*TEXTS, None, "ÄÖ — ?", "a a a b", "word " * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, `the.text` string")
    got = {r.id: r.v for r in embed(df, "the.text", "v", HashedTerms(16)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain_vector(t, 16))
    assert embed(df.limit(0), "the.text").count() == 0


def test_any_embedder(spark):
    def lengths(texts):
        return np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.embedding for r in embed(df, "t", embedder=lengths).collect()] == [[2.0, 1.0], [0.0, 1.0]]


def test_upsert(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path / "v"), buckets=4)
    assert store.read() is None and store.version() == 0 and store.search(rows(spark, (1, "x")).withColumnRenamed("chunk_id", "q"), "q", "text").count() == 0
    first = rows(spark, *enumerate(TEXTS), (None, "no key"), (3, "stress"))
    assert store.upsert(first, metadata="m") == {"inserted": 5, "updated": 0, "unchanged": 0}
    held = {r.chunk_id: (r.text, r.metadata["topic"]) for r in store.read().collect()}
    assert held == {i: (t, "x") for i, t in enumerate(TEXTS)}  # of two rows with key 3 the greater text
    # a rerun changes nothing and writes nothing
    assert store.upsert(first, metadata="m") == {"inserted": 0, "updated": 0, "unchanged": 5} and store.version() == 1
    assert store.upsert(rows(spark, (1, "new text"), (0, TEXTS[0]), (9, "more")), metadata="m") == {"inserted": 1, "updated": 1, "unchanged": 1}
    now = {r.chunk_id: r for r in store.read().collect()}
    assert sorted(now) == [0, 1, 2, 3, 4, 9] and now[1].embedding == pytest.approx(plain_vector("new text", 256)) and now[0].text == TEXTS[0]
    # the older snapshot is still there; other metadata is a change
    assert {r.text for r in store.read(1).collect()} == set(TEXTS)
    assert store.upsert(rows(spark, (9, "more")).withColumn("m", F.create_map(F.lit("topic"), F.lit("y"))), metadata="m")["updated"] == 1
    found = store.search(rows(spark, (9, "new text")).withColumnRenamed("chunk_id", "q"), "q", "text", k=2).orderBy("rank").collect()
    assert (found[0].chunk_id, found[0].similarity) == (1, pytest.approx(1.0)) and len(found) == 2
    with pytest.raises(Exception, match="exist"):
        store.commits.add(store.version(), {})  # another change was first
    store.reset()
    assert store.read() is None


def test_a_failed_change_leaves_the_table(spark, tmp_path):
    store = VectorTable(spark, str(tmp_path / "v"), buckets=2)
    store.upsert(rows(spark, (1, "a"), (2, "b")))

    class Broken:
        def __call__(self, texts):
            raise ValueError("no model")

    with pytest.raises(Exception, match="no model"):
        VectorTable(spark, str(tmp_path / "v"), embedder=Broken(), buckets=2).upsert(rows(spark, (1, "c")))
    assert {r.text for r in store.read().collect()} == {"a", "b"} and store.version() == 1
    store.upsert(rows(spark, (1, "c")))
    assert {r.text for r in store.read().collect()} == {"c", "b"}


def test_flat_metadata(spark):
    df = spark.createDataFrame([((["a", "b"], 3, None),)], "m struct<topics: array<string>, year: int, url: string>")
    assert tuple(writers.flat_metadata(df, "m").first().m) == ("a, b", "3", None)
