"""Searches that hold a bounded part of the table in a task."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.operators import embedding, text, vector
from tidemark.plans import embedding_catalog


def test_keyword_search_is_dealt_by_chunk(spark, monkeypatch):
    monkeypatch.setattr(text, "PAIRS", 10, raising=False)
    chunks = spark.createDataFrame([(i, " ".join(f"w{i % j}" for j in range(2, 9))) for i in range(40)], "c long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w0 w0 w7"), (3, None)], "q long, text string")
    got = text.keyword_topk(chunks, queries, "c", "q", k=3)
    bag = lambda s: {w: (s or "").split().count(w) for w in (s or "").split()}
    expected = []
    for q in queries.collect():
        own = bag(q.text)
        scores = sorted((-sum(min(n, bag(c.text).get(w, 0)) for w, n in own.items()) / max(1, len(own)), c.c) for c in chunks.collect())
        expected += [(q.q, c, round(-s, 9), i + 1) for i, (s, c) in enumerate(scores[:3])]
    assert sorted((r.q, r.c, round(r.similarity, 9), r["rank"]) for r in got.collect()) == sorted(expected)
    # one task holds about PAIRS of a query and a chunk: 40 chunks and 3 queries are 12 parts
    plans = []
    monkeypatch.setattr(text, "saved", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    text.keyword_topk(chunks, queries, "c", "q", k=3)
    assert re.search(r"RepartitionByExpression \[c#\d+L?\], 12", plans[-1])


def test_rows_are_not_dealt_for_a_block_of_queries(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0])], "id long, v array<double>").repartition(3)
    queries = rows.where("id % 20 = 0")
    near = vector.cosine_topk(rows, queries.withColumnRenamed("id", "q"), "id", "q", "v", 4)
    assert "FlatMapGroupsInPandas" not in near._jdf.queryExecution().optimizedPlan().toString()
    held = {r.id: np.array(r.v) for r in rows.collect() if r.v is not None}
    unit = {i: v / max(np.linalg.norm(v), 1e-12) for i, v in held.items()}
    expected = []
    for q in (0, 20, 40):
        first = sorted((-round(float(unit[q] @ v), 9), i) for i, v in unit.items() if i != q)[:4]
        expected += [(q, i, -s, n + 1) for n, (s, i) in enumerate(first)]
    assert sorted((r.q, r.id, r.similarity, r["rank"]) for r in near.collect()) == sorted(expected)


def test_chunk_sizes_save_texts_without_vectors(spark, monkeypatch):
    held, save = [], embedding_catalog.saved
    monkeypatch.setattr(embedding_catalog, "saved", lambda df, name: (held.append(df.columns), save(df, name))[1])
    got = embedding_catalog.chunk_size_sweep(spark, "/root/testdata/sf0.001")
    assert held == [["size", "chunk_id", "chunk"]] and got.columns[0] == "size"


def plain_pieces(body, size, overlap, separators=text.SEPARATORS):
    atoms = [body]
    for sep in separators:
        atoms = [p + sep * (i < len(parts) - 1) for a in atoms for parts in [a.split(sep) if len(a) > size else [a]] for i, p in enumerate(parts)]
    atoms = [a[i : i + size] for a in atoms for i in range(0, len(a), size)]
    out, held = [], []
    for a in atoms:
        if held and sum(map(len, held)) + len(a) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(a) > size):
                held.pop(0)
        held.append(a)
    return [*out, "".join(held)] if held else out


def texts_of(seed, n):
    rng = random.Random(seed)
    seps = ["\n## ", "\n### ", "\n\n", "\n", " ", " ", " ", "\n\n\n", "", "#"]
    return ["".join(rng.choice("éw日İA7") * rng.randint(0, rng.choice([2, 8, 60, 300])) + rng.choice(seps) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_piece_spans_equal_the_plain_splitter():
    rng = random.Random(1)
    for body in texts_of(2, 600):
        size = rng.choice([1, 2, 7, 30, 90, 200])
        overlap, separators = rng.choice([0, 1, size // 8, size // 2, size]), rng.choice([text.SEPARATORS, text.SEPARATORS, ("\n", "\n\n"), (" ",), ()])
        spans = text.piece_spans(body, size, overlap, separators)
        assert [body[a:b] for a, b in spans] == plain_pieces(body, size, overlap, separators), (body, size, overlap, separators)


def test_vectors_of_stretches():
    rng, terms = random.Random(3), embedding.HashedTerms(16)
    for body in [t for t in texts_of(4, 200) if t]:
        at = sorted(sorted((rng.randint(0, len(body)), rng.randint(0, len(body)))) for _ in range(9))
        got = terms.spans(body, *np.array(at).T)
        for row, (a, b) in zip(got, at, strict=True):
            plain = np.zeros(16)
            for w in re.findall("[a-z0-9]+", body[a:b].lower()):
                h = hashlib.md5(w.encode()).hexdigest()
                plain[int(h[:8], 16) % 16] += 1 if h[8] < "8" else -1
            assert np.allclose(row, plain / max(np.linalg.norm(plain), 1e-300))


@pytest.mark.parametrize("own", [False, True])
def test_piece_search_equals_the_plain_one(spark, monkeypatch, own):
    embedder = (lambda texts: np.array([[len(t), t.count("A"), 1.0] for t in texts])) if own else None
    monkeypatch.setattr(embedding, "QUERIES", 7)
    monkeypatch.setattr(embedding, "BLOCK", 3)
    monkeypatch.setattr(embedding, "PART_BYTES", 100)
    bodies, sizes = [*enumerate(texts_of(5, 12), -3), (50, None), (51, ""), (52, "a a a")], {30: 8, 90: 10}
    items = [*enumerate(texts_of(6, 15)), (20, None), (21, "a")]
    queries = embedding.embed(spark.createDataFrame(items, "q long, item string"), "item", embedder=embedder).union(spark.createDataFrame([(99, None, None)], "q long, item string, v array<double>"))
    near, counts = embedding.piece_search(spark.createDataFrame(bodies, "d long, `a.b` string"), queries, "d", "q", "a.b", sizes, 4, embedder=embedder)
    vectors = embedder or embedding.HashedTerms()
    expected, number = [], {}
    for size, overlap in sizes.items():
        pieces = {d * 100_000 + i: p for d, t in bodies for i, p in enumerate(plain_pieces(t or "", size, overlap))}
        number[size] = len(pieces)
        rows = vector.unit(vectors(list(pieces.values())))
        for q, t in items:
            s = np.round(rows @ vector.unit(vectors([t or ""]))[0], 9)
            expected += [(size, q, i, -x, n + 1) for n, (x, i) in enumerate(sorted(zip(-s, pieces, strict=True))[:4])]
    got = {(r.size, r.q, r["rank"]): (r.chunk_id, r.similarity) for r in near.collect()}
    assert {k: v[0] for k, v in got.items()} == {(s, q, n): i for s, q, i, _, n in expected}
    assert all(abs(got[s, q, n][1] - x) < 2e-9 for s, q, _, x, n in expected)
    assert {r.size: r.n_chunks for r in counts.collect()} == number


def test_chunk_sizes_save_only_what_was_found(spark, monkeypatch):
    held, save = [], embedding_catalog.saved
    monkeypatch.setattr(embedding_catalog, "saved", lambda df, name: (held.append(save(df, name)), held[-1])[1])
    got = {r.size: r for r in embedding_catalog.chunk_size_sweep(spark, "/root/testdata/sf0.001").collect()}
    assert held[0].count() <= 3 * 5 * 40 < sum(r.n_chunks for r in got.values())
    assert {s: (r.n_chunks, r.n, r.hit1, r.hit5, r.mrr) for s, r in got.items()} == {500: (1260, 40, 0.05, 0.05, 0.05), 900: (744, 40, 0.025, 0.025, 0.025), 1500: (468, 40, 0.025, 0.025, 0.025)}


def test_chunk_sizes_without_passages_or_documents(spark, tmp_path):
    docs, items = spark.createDataFrame([(1, "a b " * 300)], "doc_id long, text string"), spark.createDataFrame([(1, "b")], "item_id long, text string")
    for name, d, i in (("items", docs, items.limit(0)), ("docs", docs.limit(0), items)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        i.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = embedding_catalog.chunk_size_sweep(spark, f"{tmp_path}/{name}").orderBy("size").collect()
        assert [tuple(r) for r in got] == [(s, n if name == "items" else 0, 0, None, None, None) for s, n in ((500, 3), (900, 2), (1500, 1))]
