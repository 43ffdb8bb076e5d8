"""Corpus operators against SQL, brute force, exact round trips and edge cases."""

import hashlib
import sys
import zlib
from collections import Counter
from functools import reduce
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import same  # noqa: E402

from tidemark.llm import bottomk, fingerprint, int8dedup, langid, licenses, packing, queries, recompress, spm, tokenbin, toxicity, wordbpe  # noqa: E402
from tidemark.llm.common import connected_components  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, k string, t string, _found int"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, ties, repeated rows, clashing column names."""
    base = " ".join(WORDS)
    texts = [(1, base), (1, base), (2, None), (None, "null id " + base), (3, ""), (4, " \t\n"), (5, base + " tail"), (6, "x"), (7, "word " * 30_000), (8, "Ünïcode “quotes” <|endoftext|> é́ 日本語 " * 3), (9, base)]
    return spark.createDataFrame([(i, t, "a", "b", 0) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def brute_removed(texts: list[tuple[int, str]], window: int = 20) -> dict[int, list[str]]:
    first, out = {}, {}
    for i, t in sorted(texts):
        w = t.encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), (i, p)) != (i, p):
                gone |= set(range(p, p + window))
        out[i] = [x.decode() for j, x in enumerate(w) if j not in gone]
    return out


@pytest.mark.parametrize("chunk", [50, 1_000_000])
def test_substring_dedup_against_brute_force(spark, chunk, monkeypatch):
    monkeypatch.setattr(recompress, "CHUNK_WORDS", chunk)
    rng = np.random.default_rng(7)
    passages = [[f"w{x}" for x in rng.integers(0, 50, int(n))] for n in rng.integers(18, 60, 12)]
    texts = []
    for i in range(80):
        w = [f"u{i}_{x}" for x in rng.integers(0, 1000, int(rng.integers(0, 30)))] + passages[int(rng.integers(12))] + ["same"] * int(rng.integers(0, 50)) + ["a", "b"] * int(rng.integers(0, 30))
        texts.append((i, " ".join(w)))
    texts += [(100 + i, texts[i % 7][1]) for i in range(20)]
    got = {r.k: r.kept_text for r in recompress.dedup_substrings(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: " ".join(w) for i, w in brute_removed(texts).items()}


def test_substring_dedup_edges(spark, odd):
    got = recompress.dedup_substrings(odd).collect()
    assert len(got) == 11 and sum(r.k == 1 and r.n_removed == 0 for r in got) == 0  # the null id comes first and holds the passage
    assert next(r for r in got if r.k == 7).n_removed == 30_000 - 1
    assert recompress.dedup_substrings(odd.limit(0)).count() == 0


def brute_links(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in texts}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("tile", "shingles"), [(4, 1 << 21), (1024, 500), (1024, 1 << 21)])
def test_near_duplicates_against_brute_force(spark, tile, shingles, monkeypatch):
    monkeypatch.setattr(bottomk, "TILE", tile)
    monkeypatch.setattr(bottomk, "TILE_SHINGLES", shingles)
    rng = np.random.default_rng(3)
    shared, texts = [f"p{x}" for x in range(60)], {}
    for i in range(150):
        if i % 3 and texts:
            w = texts[int(rng.integers(0, i))].split()
            for _ in range(int(rng.integers(0, 6))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(1000)}"
        else:
            w = [f"v{x}" for x in rng.integers(0, 3000, int(rng.integers(3, 90)))] + (shared if i % 2 else [])
        texts[i] = " ".join(w)
    got = {r.k: r.component for r in bottomk.link_near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_links(texts)


def test_near_duplicates_edges(spark, odd):
    got = bottomk.link_near_duplicates(odd).collect()
    assert len(got) == 11
    comp = Counter((r.k, r.component) for r in got)
    assert comp[(1, -(2**63))] == 2 and comp[(9, -(2**63))] == 1 and comp[(2, 2)] == 1  # chained through the null id's text
    assert bottomk.link_near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_embeddings_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = {r.k: (r.n_links, r.component) for r in int8dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got.pop(-(2**63)) == (0, -(2**63))
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 11: (3, 1), **{i: (0, i) for i in (4, 5, 6, 7, 8, 9, 10)}}


def test_embedding_bound_loses_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 16))
    y = x[:200] + rng.normal(size=(200, 16)) * 0.35
    c = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    found = set(zip(*int8dedup.possible_pairs(x, y, 0.93), strict=True))
    assert set(zip(*np.nonzero(c >= 0.93), strict=True)) <= found


@pytest.mark.parametrize("dims", [1040, 4096])
def test_embedding_bound_holds_in_wide_vectors(dims):
    """All codes at their largest: sums in float32 alone would be rounded."""
    x = np.ones((2, dims))
    x[1, : dims // 2] -= 1e-4
    codes = int8dedup.quantise(x)
    product = codes[0].astype(np.int64) @ codes[0].astype(np.int64).T
    truth = product * codes[1][:, None] * codes[1]
    bound = codes[3][:, None] * codes[2] + codes[3]
    at = truth + bound
    assert (int8dedup.near(codes, codes, float(at.min()) + int8dedup.SLACK) == (at >= at.min())).all()


def test_embeddings_of_any_size_link(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 2100))
    rows = [(i, [float(c) for c in base[i % 3] * s], "x" if i < 9 else "y", i) for i, s in enumerate([1.0, 1e200, 1e-200, 3.0, 2e200, 1e-250, 1e150, 1.0, 5.0, 1.0, 1.0, 1.0])]
    rows += [rows[0], (50, [1.0, 2.0], "x", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, h int")
    got = Counter((r.k, r.n_links, r.component) for r in int8dedup.link_embeddings(df).collect())
    assert got == Counter({(i, 3 if i % 3 == 0 else 2, i % 3): 2 if i == 0 else 1 for i in range(9)} | {(9, 0, 9): 1, (10, 0, 10): 1, (11, 0, 11): 1, (50, 0, 50): 1})
    assert int8dedup.link_embeddings(df.limit(0)).count() == 0


def test_embeddings_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 12))
    x = np.r_[x, x[rng.integers(0, 40, 80)] + rng.normal(size=(80, 12)) * 0.25]
    label = rng.integers(0, 2, 120)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(120, dtype=bool)
    reach = linked | np.eye(120, dtype=bool)
    for _ in range(7):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(120)]
    got = {r.k: (r.n_links, r.component) for r in int8dedup.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=16).collect()}
    assert got == {i: (int(linked[i].sum()), int(np.flatnonzero(reach[i])[0])) for i in range(120)}


def test_merged_sketches_are_sketches_of_the_union(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(f"m{x}" for x in rng.integers(0, 500, n)) for n in (5, 6, 7, 8, 12, 30, 400, 5, 9, 0)]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    h = F.array_sort(F.array_union(fingerprint.shingle_hashes(F.col("a")), fingerprint.shingle_hashes(F.col("b"))))
    own, other = fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))
    bound = -(2**63) + 2**61
    for r in df.select(h.alias("h"), fingerprint.merge(own, other).alias("m"), own.alias("s"), other.alias("t"), fingerprint.containment(own, other).alias("c")).collect():
        assert r.m == ([x for x in r.h if x < bound] or r.h[:1])
        least = min(len(r.s), len(r.t))
        assert r.c == (len(set(r.s) & set(r.t)) / least if least else float(len(r.s) == len(r.t)))


def whole_ids(texts: list[str]) -> list[list[int]]:
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(wordbpe.vocabulary()).encode_batch(texts, add_special_tokens=False)]


def test_word_cache_equals_whole_text_encoding(docs, odd):
    texts = [r.text or "" for d in (docs, odd) for r in d.select("text").collect()] + ["a.b, (c). İ. Σίσυφος. don't. x² ½. <|ENDOFTEXT|>", "é. ³, ．"]
    got = wordbpe.WordEncoder(wordbpe.vocabulary()).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == whole_ids(texts)


def test_token_files(spark, docs, odd, tmp_path):
    for df in (docs, odd):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x))
        manifest = tokenbin.write_token_files(df, out_dir=f"file://{tmp_path}/{len(rows)}", sequence=64, shard_bytes=100_000)
        got = sorted(tokenbin.read_token_files(manifest).collect(), key=lambda r: r.start)
        at = 0
        for r, (i, _), ids in zip(got, rows, whole_ids([t for _, t in rows]), strict=True):
            ids = [*ids, 2]
            assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
            assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
        files = sorted(manifest.collect(), key=lambda f: (f.shard, f.part))
        assert [f.start for f in files] == [sum(f.n_tokens for f in files[:i]) for i in range(len(files))]
    reader = tokenbin.ShardReader(manifest.first().stem)
    assert len(reader.sequence_ids(0)) == 64 and not reader.sequence_ids(0).flags.owndata
    assert tokenbin.read_token_files(tokenbin.write_token_files(odd.limit(0))).count() == 0


def test_rows_without_an_id_are_spread(spark):
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"))
    groups = packing.pack_documents(df, group_docs=100).select((F.col("sequence_id") / 2**32).cast("int")).distinct().count()
    assert groups == 30
    files = tokenbin.write_token_files(df, shard_bytes=4096).collect()
    assert len({f.shard for f in files}) > 4 and max(f.n_docs for f in files) < 1500 and sum(f.n_docs for f in files) == 3000


def test_plain_words_equal_whole_text_encoding():
    rng, letters = np.random.default_rng(4), "abcéß'sdrevlmt0123.,!?\"#$%&()*+-/:;<=>@[]^_`{|}~ \t\nÉÀıſKÅ漢字é́ ．⁄'\x01\x7f\x85"
    texts = ["".join(letters[x] for x in rng.integers(0, len(letters), n)) for n in rng.integers(1, 60, 5000)]
    got = wordbpe.WordEncoder(wordbpe.vocabulary()).encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == whole_ids(texts)


def test_packing(spark, docs, odd):
    for df in (docs, odd):
        rows = packing.pack_documents(df, group_docs=64).collect()
        bins = {}
        for r in rows:
            assert r.length == len(r.ids) // 4 <= 4096
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 4096
        expected = Counter(len(x) + 1 for x in whole_ids([r.text or "" for r in df.select("text").collect()]))
        assert Counter(r.doc_tokens for r in rows if r.start == 0) == expected and sum(r.length for r in rows) == sum(k * v for k, v in expected.items())
        pieces = [(r.doc_id, i, bytes(np.array(ids[i : i + 4096], "<u4"))) for r, ids in zip(df.collect(), ([*x, 2] for x in whole_ids([r.text or "" for r in df.select("text").collect()])), strict=True) for i in range(0, len(ids), 4096)]
        assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in rows) == Counter(pieces)
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_first_fit_decreasing_against_plain_search():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 100, 300).tolist(), reverse=True)
    free, expected = [], []
    for s in sizes:
        b = next((i for i, f in enumerate(free) if f >= s), len(free))
        if b == len(free):
            free.append(100)
        free[b] -= s
        expected.append(b)
    assert packing.first_fit_decreasing(sizes, 100)[0] == expected


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def plain_sketch(text: str) -> list[int]:
    """Hashes of runs of five words below an eighth of the range, or the smallest one."""
    from xxhash import xxh64

    def chain(values: list[int]) -> int:
        seed = 42
        for v in values:
            seed = xxh64((v % 2**64).to_bytes(8, "little"), seed).intdigest()
        return signed(seed)

    h = [signed(xxh64(w, 42).intdigest()) for w in text.lower().encode().split()]
    every = [chain(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [reduce(lambda s, x: chain([s, x]), h, 42)] if h else []
    return sorted({x for x in every if x < -(2**63) + 2**61 or x == min(every)})


def plain_likeness(a: list[int], b: list[int]) -> float:
    least = min(len(a), len(b))
    return len({*a} & {*b}) / least if least else float(len(a) == len(b))


@pytest.mark.parametrize(("ranges", "size"), [(1024, 8192), (1024, 16), (3, 4)])
def test_fingerprints(spark, docs, odd, monkeypatch, ranges, size):
    from xxhash import xxh64

    monkeypatch.setattr(fingerprint, "MAX_RANGES", ranges)
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", size)
    hot = spark.createDataFrame([(None if i % 3 else 7 if i % 4 else i, f"text {i} " + " ".join(WORDS[i % 7 : i % 7 + 9])) for i in range(300)], "doc_id long, text string")
    for df in (docs, odd, hot):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, signed(xxh64(x[1].encode(), 42).intdigest())))
        got = fingerprint.fingerprint_documents(df)
        own, edited, beyond = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
        got = got.select("doc_id", "n_chars", "edited_text", "sketch", fingerprint.containment(own, edited).alias("e"), fingerprint.containment(own, beyond).alias("n")).collect()
        expected = []
        for i, (k, t) in enumerate(rows):
            after, half = rows[i - 1][1], len(t) // 2
            new, s = t[: len(t) - half] + after[:half], plain_sketch(t)
            expected.append((k, len(t), new, tuple(s), plain_likeness(s, plain_sketch(new)), plain_likeness(s, plain_sketch(after))))
        assert Counter((r.doc_id, r.n_chars, r.edited_text, tuple(r.sketch), r.e, r.n) for r in got) == Counter(expected)
    most = fingerprint._in_ranges(hot.select(fingerprint.key_of("doc_id").alias("k"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))).groupBy("r").count().agg(F.max("count")).first()[0]
    assert most <= 300 if size > 300 else most <= 4 * size
    assert fingerprint.fingerprint_documents(odd.limit(0)).count() == 0


def test_fingerprint_keeps_a_fixed_fraction(spark):
    from xxhash import xxh64

    words = [f"t{i % 97}x{i}" for i in range(400)]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h = [signed(xxh64(w.encode(), 42).intdigest()) for w in words]

    def chain(values):
        seed = 42
        for v in values:
            seed = xxh64((v % 2**64).to_bytes(8, "little"), seed).intdigest()
        return signed(seed)

    every = [chain(h[i : i + 5]) for i in range(396)]
    expected = sorted({x for x in every if x < -(2**63) + 2**61 or x == min(every)})
    got = spark.createDataFrame([(" ".join(words),)], "t string").select(fingerprint.sketch(F.col("t"))).first()[0]
    assert got == expected


def test_language_model(spark, docs, odd):
    model = langid.fit_language_model(docs)
    out = langid.identify_languages(docs, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right / n > 0.9
    got = {r.doc_id: r for r in langid.identify_languages(odd, model).collect()}
    assert len(got) == 10 and got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[1].k == "a"
    empty = langid.fit_language_model(docs.limit(0))
    assert {r.lang_pred for r in langid.identify_languages(odd, empty).collect()} == {"und"}


def test_segments_against_brute_force():
    rng = np.random.default_rng(5)

    def brute(s, lo, hi):
        best = max(((s[a:b].sum(), -(b - a), -a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        if best[0] <= 1e-12:
            return []
        a, b = -best[2], best[3]
        return [*brute(s, lo, a), (a, b), *brute(s, b, hi)]

    for _ in range(60):
        s = rng.normal(-0.2, 1, int(rng.integers(1, 14)))
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(s)] == brute(s, 0, len(s))


def test_toxicity(spark, odd):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join([*(f"n{x}" for x in rng.integers(0, 300, 60)), *(["vilest", "scoundrel", "vilest"] if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(1500)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity_model(docs, labels)
    out = toxicity.score_toxicity(docs, model).join(labels, "doc_id")
    assert out.where((F.col("toxicity") >= 0.3) != (F.col("toxic") == 1)).count() == 0
    assert {r.toxicity < 0.3 for r in toxicity.score_toxicity(odd, model).collect()} == {True}
    nothing = toxicity.fit_toxicity_model(docs, labels.limit(0))
    assert toxicity.score_toxicity(odd, nothing).count() == 11
    apart = toxicity.fit_toxicity_model(docs, labels.withColumn("doc_id", F.col("doc_id") + 5000))
    assert {r.toxicity < 0.3 for r in toxicity.score_toxicity(odd, apart).collect()} == {True}


def test_repeated_words_count_once():
    assert toxicity.repeats("a a b a c a d d d".split()).tolist() == [False, True, False, True, False, True, False, True, True]
    model = toxicity.ToxicityModel({"odd": 0.8, "insult": 6.0}, 2.4, 1.0, -3.0, 0.26)
    assert model.score("odd " * 500)[0] < 0.3 < 0.9 < model.score("plain words and an insult here")[0]
    assert model.score("insult " * 3 + "plain " * 9) == model.score("insult " + "plain " * 11)[:2] + (["insult"],)


def test_tail_rate_and_calibration():
    s, p = np.array([-1.0, 1.0]), np.array([0.75, 0.25])
    assert abs(toxicity.tail_rate(s, p) - np.log(3)) < 1e-9  # 0.75 / x + 0.25 x = 1 at x = 3
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(0.9 * x - 4)))).astype(int)
    slope, offset = toxicity._fit_line(x, y)
    assert abs(slope - 0.9) < 0.1 and abs(offset + 4) < 0.4


def test_shrunk_odds_against_plain_formula():
    y1, y0, share = 30, 4, 0.002
    prior = min(max(toxicity.PRIOR * share, toxicity.LEAST_PRIOR), toxicity.PRIOR / 2)
    delta = np.log((y1 + prior) / (100 + toxicity.PRIOR)) - np.log((y0 + prior) / (900 + toxicity.PRIOR))
    error = np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
    got = toxicity.shrunk_odds(np.array([30.0]), np.array([4.0]), 100, 900, np.array([share]))[0]
    assert abs(got - (delta - toxicity.CONFIDENCE * error)) < 1e-12


def test_many_weak_segments_of_a_long_text_count():
    model = toxicity.ToxicityModel({"insult": 7.0}, 1.0)
    words = ["plain"] * 20_000
    words[100:20_000:199] = ["insult"] * 100
    segments = model.passages(" ".join(words))[0]
    assert len(segments) == 100 and 73 < model.statistic(segments, 20_000) < 74
    p, n, found = model.score(" ".join(words))
    assert p > 0.99 and n == 100 and set(found) == {"insult"}
    assert model.score(" ".join(["plain"] * 20_000))[0] == 0.5
    few = [w if i < 2000 else "plain" for i, w in enumerate(words)]  # by chance about 18
    assert model.score(" ".join(few))[:2] == (0.5, 0)


def test_rare_and_moderate_insults_count(spark):
    """Insults of 20 toxic texts each, and one of 10 % of the toxic and 0.75 % of the clean texts."""
    assert toxicity.shrunk_odds(np.array([20.0]), np.array([0.0]), 8000, 8000, np.array([1e-4]))[0] > 2
    assert toxicity.shrunk_odds(np.array([800.0]), np.array([60.0]), 8000, 8000, np.array([0.01]))[0] > 2
    assert toxicity.shrunk_odds(np.array([60.0]), np.array([800.0]), 8000, 8000, np.array([0.01]))[0] < -2
    rng = np.random.default_rng(5)
    letters = [a + b for a in "bcdfghjklm" for b in "aeiou"]
    plain = [a + b for a in letters for b in letters]
    rows = []
    for i in range(2400):
        text = [plain[x] for x in (rng.pareto(1.0, 80) * 20).astype(int) % len(plain)]
        toxic = i % 3 == 0
        rows.append((i, " ".join([*text[:40], *([f"zz{'qxvw'[i % 4]}{'qxvwzjkpyt'[i // 80 % 10]}"] * 2 if toxic else []), *text[40:]]), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_toxicity_model(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = toxicity.score_toxicity(df, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).toPandas()
    flagged = out.toxicity >= toxicity.THRESHOLD
    assert flagged[out.toxic == 1].mean() > 0.9 and flagged[out.toxic == 0].mean() < 0.05


def test_licenses(spark, odd):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://x\nUnless required by applicable law or agreed to in writing, software is as is.'
    rows = [(1, apache), (2, "text\nReleased under the MIT License.\nmore. All rights reserved."), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under CC BY-NC 4.0."), (5, "no such thing"), (6, None), (7, "Redistributions of source code must retain the above copyright notice, x.")]
    got = {r.doc_id: (r.licenses, r.unmatched) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (["Apache-2.0"], []), 2: (["MIT", "Proprietary"], []), 3: (["GPL-3.0-only"], []), 4: (["CC-BY-NC-4.0"], []), 5: ([], []), 6: ([], []), 7: ([], ["bsd_source"])}
    assert licenses.scan_licenses(odd).count() == 11


def test_sentencepiece(spark, docs, odd):
    path = wordbpe.vocabulary("piece_bpe_32k.model")
    for df in (docs, odd):
        out = spm.encode_pieces(df, path)
        assert out.where("not parity or not round_trip").count() == 0 and out.count() == df.count()


def test_parity_by_chunk_is_parity_of_whole_texts(docs, odd):
    own = spm.Codec(wordbpe.vocabulary("piece_bpe_32k.model"))
    texts = [r.text or "" for d in (docs, odd) for r in d.select("text").collect()] + ["", " ", "ends with a space ", "  two  spaces  ", "a▁b ▁ c", "<0x41> <unk> <s>", "🙂 é\tx\n"]
    ids, odd_texts = own.encode_normalised(own.normalise(texts))
    assert own.parity_by_chunk and ids == [np.array(x, "<u4").tobytes() for x in own.other.encode(texts)]
    assert all(own.parity(texts, ids, odd_texts))
    own.odd.add("▁▁▁two")
    assert own.parity(texts, *own.encode_normalised(own.normalise(texts)))[-4] is False


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
@pytest.mark.parametrize("options", [{}, {"byte_fallback": True}, {"byte_fallback": True, "normalization_rule_name": "identity", "remove_extra_whitespaces": False}, {"user_defined_symbols": ["[USER]", "<sep>"], "control_symbols": ["<ctl>"]}, {"add_dummy_prefix": False}])
def test_other_models_equal_the_library(docs, tmp_path, kind, options):
    """Models trained for this test alone: unigram, byte fallback, control and user-defined pieces, character maps."""
    import sentencepiece

    corpus = [(r.text or "")[:2000] for r in docs.select("text").collect()]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(corpus), model_prefix=f"{tmp_path}/m", model_type=kind, vocab_size=800, minloglevel=2, hard_vocab_limit=False, **options)
    own = spm.Codec(f"{tmp_path}/m.model")
    texts = ["", " ", "  a  b ", "<s> </s> <unk> <ctl>", "x<0x41>y <0xE2>", "日本語 テキスト", "é ﬁ Ａ ½ ①", "a▁b ▁ c", "tab\tnew\nline\r\n", "[USER] foo[USER]bar", "foo<sep>bar <sep>", "\u3000ideographic\u00a0nbsp", "🙂🙂 emoji", "é combining", "and the of error"]
    ids, odd_texts = own.encode_normalised(own.normalise(texts))
    expected = own.other.encode(texts)
    assert ids == [np.array(x, "<u4").tobytes() for x in expected]
    assert all(own.parity(texts, ids, odd_texts))
    assert own.decode([np.frombuffer(x, "<u4") for x in ids]) == own.other.decode(expected)


def test_decoding_pieces(spark, odd):
    path = wordbpe.vocabulary("piece_bpe_32k.model")
    back = spm.decode_pieces(spm.encode_pieces(odd, path), path)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    broken = spm.Codec(path).decode([np.array([3 + 0xE2, 3 + 0x82], np.uint32)])
    assert broken == [spm.Codec(path).other.decode([3 + 0xE2, 3 + 0x82])]
    assert spm.encode_pieces(odd.limit(0), path).count() == 0 == spm.decode_pieces(spm.encode_pieces(odd.limit(0), path), path).count()


def test_pipeline_runs_and_shrinks(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert cp.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == len(kept)


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage, on what the one before kept, row by row, with odd rows and columns whose names clash with the operators' own."""
    import corpus_pipeline as cp

    base = " ".join(WORDS)
    odd = [(None, "null id " + base), (901, base), (901, base), (902, None), (903, ""), (904, " \t\n"), (905, base + " tail"), (906, "12 34"), (907, "Über " * 6000), (908, base)]
    clash = ["k", "th", "row", "own", "kept", "n_removed", "n_words", "toxicity", "lang_pred", "component", "start"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rng = np.random.default_rng(8)
    rude = [(10_000 + i, " ".join([*(f"n{chr(97 + x % 26)}{chr(97 + x // 26)}" for x in rng.integers(0, 300, 60)), *(["vilest", "scoundrel", "knave"] if i % 4 == 0 else [])])) for i in range(400)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels = labels.unionByName(spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in rude], labels.schema))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd + rude], source.schema)
    docs = source.unionByName(more).withColumns({c: F.lit(n) for n, c in enumerate(clash)}).cache()
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    at = docs.columns.index("text")
    key = lambda r: -(2**63) if r[0] is None else r[0]
    stages = dict(cp.STAGES)

    model = toxicity.fit_toxicity_model(docs, labels)
    made = stages["toxicity"](spark, docs, str(tmp_path)).cache()
    given, got = rows(docs), rows(made)
    assert made.columns == docs.columns and got == Counter({r: n for r, n in given.items() if model.score(r[at])[0] < toxicity.THRESHOLD})
    assert {r[0] for r in given - got} >= {i for i, _ in rude if i % 4 == 0} and len(given - got) < 120

    found = langid.fit_language_model(made)
    sure = lambda t: (p := found.predict(t))[0] != "und" and p[1] >= cp.MIN_LANGUAGE_SCORE
    made, given = stages["language"](spark, made, str(tmp_path)).cache(), got
    got = rows(made)
    assert got == Counter({r: n for r, n in given.items() if sure(r[at])})
    # what has no letters went; here it comes back, so that the later stages meet it
    made = made.unionByName(docs.where("source = 'odd'").join(made.where("source = 'odd'").select("doc_id").distinct(), "doc_id", "left_anti")).cache()

    given = rows(made)
    first = brute_links({key(r): r[at] or "" for r in given})
    made = stages["near_dedup"](spark, made, str(tmp_path)).cache()
    got = rows(made)
    assert got == Counter({r: n for r, n in given.items() if first[key(r)] == key(r)}) and len(got) < len(given)

    left = brute_removed([*{(key(r), r[at] or "") for r in got}])
    chars = docs.columns.index("n_chars")
    expected: Counter = Counter()
    for r, n in got.items():
        text = " ".join(left[key(r)])
        if len(left[key(r)]) == len((r[at] or "").encode().split()):
            text = r[at]
        elif not text:
            continue
        expected[tuple(text if i == at else (None if text is None else len(text)) if i == chars else v for i, v in enumerate(r))] += n
    made = stages["substring_dedup"](spark, made, str(tmp_path)).cache()
    got = rows(made)
    assert made.columns == docs.columns and got == expected

    pieces = stages["packing"](spark, made, str(tmp_path)).collect()
    ids = [[*x, 2] for x in whole_ids([r[at] or "" for r in got.elements()])]
    assert Counter((r.doc_id, r.start, bytes(r.ids)) for r in pieces) == Counter((r[0], i, bytes(np.array(x[i : i + 4096], "<u4"))) for r, x in zip(got.elements(), ids, strict=True) for i in range(0, len(x), 4096))


def test_stages_of_an_empty_table(spark, docs):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_run_is_the_stages_in_order(spark, docs):
    import corpus_pipeline as cp

    made = docs
    for _, stage in cp.STAGES:
        made = stage(spark, made, SF).cache()
    mark = lambda df, crc: Counter(df.select("doc_id", "start", "length", crc).collect())
    assert mark(cp.run(spark, SF), "ids_crc32") == mark(made, F.crc32("ids").alias("ids_crc32"))


def test_ftrl_against_plain_formulas():
    """One coordinate after another, by the closed form of the per-coordinate minimum."""
    rng = np.random.default_rng(4)
    vectors = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(40)]
    labels = np.array([int(f[0] > 2) + int(f[-1] > 9) for f, _ in vectors])
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(f, c):
        s = z.get((f, c), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - l1 * (1 if s > 0 else -1)) / ((beta + n.get((f, c), 0.0) ** 0.5) / alpha + l2)

    for epoch in range(4):
        for i in np.random.default_rng(epoch).permutation(40):
            x = {**dict(zip(vectors[i][0].tolist(), vectors[i][1].tolist(), strict=True)), 12: 1.0}
            w = {(f, c): weight(f, c) for f in x for c in range(3)}
            e = [np.exp(sum(w[f, c] * v for f, v in x.items())) for c in range(3)]
            for f, v in x.items():
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == labels[i]))
                    before = n.get((f, c), 0.0)
                    z[f, c] = z.get((f, c), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * w[f, c]
                    n[f, c] = before + g * g
    got = langid.train_ftrl(vectors, labels, 12, 3)
    assert np.allclose(got, [[weight(f, c) for c in range(3)] for f in range(13)]) and (got == 0).any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 4, 500)
    margins = rng.normal(0, 1, (500, 4)) + 2 * np.eye(4)[labels]
    best = langid.fit_temperature(5 * margins, labels)
    loss = lambda t: -np.log(langid.softmax(5 * margins / t)[np.arange(500), labels]).mean()
    assert loss(best) <= min(loss(t) for t in np.geomspace(0.1, 20, 200)) + 1e-6


def test_predictions_are_those_of_the_plain_model(spark, docs, odd):
    model = langid.fit_language_model(docs)
    for df in (docs, odd):
        got = langid.identify_languages(df, model).collect()
        assert [(r.lang_pred, r.lang_score) for r in got] == [model.predict(r.text) for r in got]
