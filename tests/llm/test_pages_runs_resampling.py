"""Main text of pages, periodic runs and importance resampling against brute force, and on odd rows."""

import hashlib
import html
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import importance, pages, queries, runs

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, `a.b` string, _weighed int, _runs int, _main int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, clashing and dotted column names."""
    base = " ".join(f"w{i}" for i in range(30))
    texts = [(1, base), (1, base), (2, None), (None, base), (3, ""), (4, " \t\n"), (5, "la " * 40), (6, "x"), (7, "one two " * 20_000), (8, "Ünï “q” <|end|> 日本語 " * 12), (9, base)]
    return spark.createDataFrame([(i, t, "r", "d", 0, 1, 2) for i, t in texts], SCHEMA)


# Periodic runs


def brute_runs(s, min_words=24, min_periods=3):
    n, out = len(s), []
    for q in range(1, n // min_periods + 1):
        x = 0
        while x + q < n:
            if s[x] != s[x + q]:
                x += 1
                continue
            a = x
            while x + q < n and s[x] == s[x + q]:
                x += 1
            length = x + q - a
            w = s[a : a + length]
            if length >= max(min_words, min_periods * q) and not any(w[d:] == w[:-d] for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = random.Random(1)
    for _ in range(800):
        k, n, s = rng.randint(1, 4), rng.randint(1, 70), []
        while len(s) < n:
            s += [rng.randint(1, k) for _ in range(rng.randint(1, 6))] * rng.randint(1, 6)
        least = rng.choice([3, 6, 12, 24])
        got = runs.runs_of([s, [1] * 30, s[::-1]], least)
        assert [list(map(tuple, g.tolist())) for g in got] == [brute_runs(x, least) for x in (s, [1] * 30, s[::-1])]
        texts = [" ".join(map(str, x)).encode() for x in (s, [], s[::-1])]
        assert [list(map(tuple, g.tolist())) for _, g in runs.text_runs(texts, least)] == [brute_runs(x, least) for x in (s, [], s[::-1])]


def test_suffix_tree_holds_every_suffix():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randint(1, 3) for _ in range(rng.randint(0, 25))]
        e = runs.Extensions([s, [2, 2]])
        assert sorted(range(len(s) + 1), key=lambda i: e.place[i]) == sorted(range(len(s) + 1), key=lambda i: [*s, 0][i:])
        for i, j in itertools.combinations(range(len(s) + 1), 2):
            same = next((k for k in range(len(s) - j) if s[i + k] != s[j + k]), len(s) - j)
            assert e.common(np.array([i]), np.array([j])).tolist() == [same]


def plain_runs_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(w)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{q}\n" for a, b, q in found)), sha(kept))


def test_runs_query_against_brute_force(spark):
    got = {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 12_000]
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    expected = {plain_runs_row(r.doc_id, r.text) for r in short}
    assert expected <= got and sum(r[1] > 0 for r in expected) > 5


def test_runs_edges(spark, odd):
    found = runs.find_runs(odd)
    assert found.columns == ["doc_id", "text", "a.b", "_weighed", "_runs", "_main", "runs", "collapsed"]
    got = found.collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 11 and by_id[2].runs == [] and by_id[2].collapsed == "" and by_id[4].collapsed == ""
    assert [tuple(x) for x in by_id[5].runs] == [(0, 40, 1)] and by_id[5].collapsed == "la"
    assert [tuple(x) for x in by_id[7].runs] == [(0, 40_000, 2)] and by_id[7].collapsed == "one two"
    assert [tuple(x) for x in by_id[8].runs] == [(0, 48, 4)] and by_id[1].collapsed == by_id[1].text
    assert runs.find_runs(odd.limit(0)).count() == 0
    assert odd.select(runs.made_periodic("doc_id", "text")).count() == 11
    with pytest.raises(ValueError):
        runs.find_runs(odd, min_periods=2)


# Importance resampling


def plain_features(text, ngram):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("ngram", [1, 2, 4])
def test_buckets_against_brute_force(ngram, monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "A b\nC", "x" * 70 + " y" * 3, "¿Qué?  ÑANDÚ 日本語 a.b,c", "one"] + ["".join(rng.choice("aB1 .é\n") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    n_words, doc, bucket = importance.batch_buckets([t and t.encode() for t in texts], ngram=ngram)
    for i, t in enumerate(texts):
        n, features = plain_features(t, ngram)
        assert n_words[i] == n and Counter(bucket[doc == i].tolist()) == Counter(features)


def plain_resample(rows, target, least=20, percent=25):
    made = [plain_features(t, 2) for _, t in rows]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in plain_features(x, 2)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    out = []
    for (i, _), (n, f) in zip(rows, made, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0]))
    drawn = fits[: percent * len(fits) // 100]
    ranks = {id(x): k + 1 for k, x in enumerate(drawn)}
    return Counter((*x, ranks.get(id(x))) for x in out)


def test_resampling_against_brute_force(spark, odd):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    goal = [r.text for r in target.collect()]
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        assert Counter(map(tuple, importance.resample(df, target).collect())) == plain_resample(rows, goal)
    more = importance.resample(odd, target, percent=100, min_words=0).collect()
    assert sorted(r["rank"] for r in more) == list(range(1, 12))


def test_resampling_edges(spark, odd):
    target = spark.createDataFrame([(1, None)], "item_id long, text string")
    assert importance.resample(odd.limit(0), target).count() == 0
    assert all(r["rank"] is None for r in importance.resample(odd, target.limit(0), percent=0).collect())
    same = spark.createDataFrame([(i % 2, "a b " * 12) for i in range(40)], "doc_id long, text string")
    got = importance.resample(same, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 21)) and len({r.score for r in got}) == 2


# Main text


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_articles_of_the_table(spark):
    rows = queries.op11_html_extraction(spark, SF).collect()
    source = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (source[r.page_id].url, article_of(source[r.page_id].html), len(r.text))


S = "The river rose again this spring, and the town moved its market to higher ground."
LAYOUTS = {
    "blog": (f'<body><header id="masthead"><p><a href="/">My site</a></p><nav><ul><li><a href="/a">Home</a><li><a href="/b">About</a></ul></nav></header><main><article class="post"><h1>A title</h1><div class="entry-content"><p>{S} {S}</p><h2>Part</h2><ul><li>One item</li><li>Second.</li></ul><p>Short.</p></div></article><section id="comments"><h3>3 comments</h3><ol><li><p>Great post, I like how you put it.</p></li></ol></section></main><aside class="sidebar"><h3>Recent</h3><ul><li><a href="x">x y</a></ul></aside><footer><p>&copy; 2020 Me.</p></footer>', f"A title\n{S} {S}\nPart\nOne item\nSecond.\nShort."),
    "divs": (f'<div class="cookie">We use cookies.</div><div class="top"><a href="/">Home</a> | <a href="/n">News</a></div><div id="main"><h1>Head</h1><div class="ads">Buy now!</div><p>{S}</p><p>{S} {S}</p><form><label>Mail</label><input></form></div><div class="footer">Contact &amp; more</div>', f"Head\n{S}\n{S} {S}"),
    "bare": (f"<h1>Old page</h1><p>{S}<p>{S} {S}<hr><p>{S}", f"Old page\n{S}\n{S} {S}\n{S}"),
    "text": (f"{S} {S}", f"{S} {S}"),
    "replies": (f'<article><h1>T</h1><p>{S} {S}</p><div class="comments"><div class="comment"><p>{S} {S}</p></div></div></article>', f"T\n{S} {S}"),
    "main": (f'<nav><a href="1">x</a></nav><main><h1>T</h1><p>{S}</p><p>{S}</p></main><section class="newsletter"><p>Sign up for our letter.</p></section><aside><p>{S}</p></aside><footer>x</footer>', f"T\n{S}\n{S}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, expected = LAYOUTS[name]
    assert pages.main_texts([page], pages.drawn_model()) == [expected]


def test_held_out_labelled_pages():
    forest = pages.Forest()
    for page in pages.drawn_pages(300, seed=77):
        forest.add(page)
    graph = pages.Graph(forest)
    p = pages.drawn_model().beliefs(graph)[0][graph.leaves]
    assert ((p >= 0.5) == graph.label[graph.leaves]).mean() > 0.96


def test_marginals_against_enumeration():
    forest = pages.Forest()
    forest.add("<nav><a href=1>a b</a></nav><div class=content><p>one two.<p>three</div>")
    forest.add("<p>x")
    graph = pages.Graph(forest)
    rng = np.random.default_rng(0)
    model = pages.PageModel(rng.normal(0, 1, graph.width), rng.normal(0, 1, (pages.OTHER + 1, 2, 2)), rng.normal(0, 1, (pages.OTHER + 1, 2, 2)))
    p, pair, log_z = model.beliefs(graph)
    n, roots = len(graph.kind), set(graph.roots.tolist())
    total, marginal, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for y in itertools.product((0, 1), repeat=n):
        if any(y[r] for r in roots):
            continue
        e = sum(model.node[graph.features[v]].sum() for v in range(n) if y[v])
        e += sum(model.child[graph.kind[v], y[graph.parent[v]], y[v]] + model.parent[graph.kind[graph.parent[v]], y[graph.parent[v]], y[v]] for v in range(n) if v not in roots)
        w = math.exp(e)
        total += w
        marginal += w * np.array(y)
        for v in range(n):
            if v not in roots:
                pairs[v, y[graph.parent[v]], y[v]] += w
    assert np.allclose(p, marginal / total) and np.allclose(pair, pairs / total) and math.isclose(log_z, math.log(total))


def test_markup():
    model = pages.drawn_model()
    page = f"<article><p>{S} a&nbsp;&lt;b&gt; &#65;&#x42; &notanentity; x<b>y</b>z<br>w\t v<script>if (a<b) '</p>'</script><!-- <p>no --><style>p{{}}</style></p><p>{S}</p></article>"
    assert pages.main_texts([page, None, "", "<p", "<!-- x", "<article></article>", "<div>" * 3000], model) == [f"{S} a <b> AB ¬anentity; xyz w v\n{S}", "", "", "", "", "", ""]


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, main_text string, _main int, `x.y` int"
    rows = [(1, "u", f"<article><p>{S}</p></article>", "m", 0, 1)] * 2 + [(None, None, None, None, None, None), (2, "u", "", "m", 0, 1), (3, "u", f"<main><p>{S}</p>{'<p>la.</p>' * 5000}</main>", "m", 0, 1)]
    df = spark.createDataFrame(rows, schema)
    found = pages.extract_main_text(df, pages.drawn_model())
    assert found.columns == ["page_id", "url", "html", "_main", "x.y", "main_text"]
    got = sorted((r.page_id or 0, r.main_text) for r in found.collect())
    assert got[:4] == [(0, ""), (1, S), (1, S), (2, "")] and got[4][1] == "\n".join([S, *["la."] * 5000])
    assert pages.extract_main_text(df.limit(0), pages.drawn_model()).count() == 0
