"""MinHash near-dedup on bottom-k sketches from one hash function.

A document's shingle set keeps its smallest hashes. Inverted lists of retained values bring documents
together, the sketch of the union estimates their likeness and drops what cannot reach the threshold,
and the full sets decide. Work is arranged so that no group is spelt out pair by pair:

1. equal sets collapse to one representative;
2. of the retained values only those that a second set has matter, and of these only a prefix, rarest
   first: sets that reach the threshold share at least ``q`` retained values, so they also share one outside
   the ``q - 1`` most frequent of each. A text with a few boilerplate values thus leaves their long lists;
3. each list links its members to its first one (a star); verified stars become components;
4. lists that still hold several components are compared in tiles of bounded size: by sketches first, then the
   texts that have a possible partner of another component come to their tile, which compares full sets and hands
   on a forest of the links it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import begin_task, connected_components, discard, key_of, mix64, release, saved, small_batches, word_hashes

SHINGLE, PERCENT = 5, 75
INDEX, SKETCH = 32, 64
#: Rows, and shingles of all its rows, in one block of a list; a tile is at most two blocks.
TILE, TILE_SHINGLES = 1024, 1 << 21
#: Share of the union's sketch that must be common before the full sets are compared. At a likeness of 0.75 a
#: sketch of 64 falls below it with a chance under 1e-8.
ESTIMATE = 0.42
#: In tiles, pairs are compared in full down to so many standard deviations below the threshold.
DEVIATIONS = 6.5
U = np.uint64


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of ``shingle`` successive words, A-Z lowered, ascending; all words if they are fewer."""
    h = word_hashes(text.lower())
    n = len(h)
    if not n:
        return h
    width = min(shingle, n)
    z = np.full(n - width + 1, U(width))
    for j in range(width):
        z = z * U(0x9E3779B97F4A7C15) + h[j : n - width + 1 + j]
    return np.unique(mix64(z))


def _signed(x: np.ndarray) -> np.ndarray:
    """Unsigned longs as longs of the same order."""
    return (x ^ U(1 << 63)).view(np.int64)


def set_mark(z: np.ndarray, c: int) -> int:
    """One of two independent hashes of a set, as a signed long."""
    return int(np.bitwise_xor.reduce(mix64(z + U(c))).astype(np.int64)) if len(z) else 0


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("bottomk")
        for batch in batches:
            keys, texts = batch.columns
            sets = [shingle_set(t, shingle) for t in texts.to_pylist()]
            marks = [[set_mark(z, c) for z in sets] for c in (1, 2)]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(z) for z in sets], pa.int64()), *(pa.array(m, pa.int64()) for m in marks), pa.array([_signed(z[:SKETCH]) for z in sets], pa.list_(pa.int64()))], names=["k", "n", "s1", "s2", "sketch"])

    return run


def _verify(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def of(key: int, text: bytes) -> np.ndarray:
            mark = hash((key, text))
            if mark not in kept:
                if len(kept) >= 256:
                    kept.clear()
                kept[mark] = shingle_set(text, shingle)
            return kept[mark]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            good = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                p, q = of(x, ta[i]), of(y, tb[i])
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def incidence(lists: list[np.ndarray]) -> np.ndarray:
    """Rows by those values that more than one row has, as 0 and 1."""
    values, inv = np.unique(np.concatenate(lists), return_inverse=True)
    common = np.bincount(inv, minlength=len(values)) > 1
    has, row = common[inv], np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    m = np.zeros((len(lists), int(common.sum())), np.float32)
    m[row[has], (np.cumsum(common) - 1)[inv[has]]] = 1
    return m


def possible(tile: pa.Table, sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of a tile's rows can be links: different components, fitting sizes, enough of both sketches in common."""
    comp, side, keys = (tile.column(c).to_numpy() for c in ("component", "own", "rep"))
    v = tile.column("v")[0].as_py() >> 32
    ok = (comp[:, None] != comp) & (keys[:, None] < keys) & (100 * sizes[:, None] >= percent * sizes) & (100 * sizes >= percent * sizes[:, None])
    if tile.column("lo")[0] != tile.column("hi")[0]:
        ok &= side[:, None] != side
    if ok.any():
        m = incidence(sketches)
        overlap = m @ m.T
        # below the smaller of two sketches' ends both are complete: that part of the union is a fair sample of it
        end = np.array([x[-1] if len(x) == SKETCH else np.iinfo(np.int32).max for x in sketches])
        below = np.stack([np.searchsorted(x, end, side="right") for x in sketches])
        seen = below + below.T - overlap
        whole = np.maximum((sizes[:, None] + sizes) / (1 + percent / 100), seen)
        share = percent / 100
        ok &= overlap >= seen * (share - DEVIATIONS * np.sqrt(share * (1 - share) / seen * (1 - seen / whole))) - 1e-9
    if ok.any():  # of the lists that a pair shares, the one of the least value decides it
        m = incidence([x[x < v] for x in _lists(tile, "prefix")])
        ok &= m @ m.T == 0
    return ok


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    lists = table.column(column).combine_chunks()
    at, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [at[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def forest(ok: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Verified links that join the components of a tile's rows, at most one fewer than there are components."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.r_[0, np.cumsum([len(z) for z in sets])]
    sizes, label, out = np.diff(cuts), np.unique(component, return_inverse=True)[1], []
    for i in np.flatnonzero(ok.any(axis=1)):
        js = np.flatnonzero(ok[i] & (label != label[i]))
        if not len(js):
            continue
        own = np.zeros(len(values), np.int64)
        own[flat[cuts[i] : cuts[i + 1]]] = 1
        both = np.array([own[flat[cuts[j] : cuts[j + 1]]].sum() for j in js])
        linked = js[100 * both >= percent * (sizes[i] + sizes[js] - both)]
        for j in linked:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def _by_tile(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """``done`` of each tile's rows, which follow each other, put together batch by batch."""
    held: list[pa.RecordBatch] = []

    def out(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        marks = [table.column(c).to_numpy() for c in ("v", "lo", "hi")]
        cut = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in marks])]).tolist()
        ends = [*cut[1:], table.num_rows]
        whole = len(cut) if last else len(cut) - 1
        tiles = (done(table.slice(a, b - a).combine_chunks()) for a, b in zip(cut[:whole], ends[:whole], strict=True) if b - a > 1)
        found = [t for t in tiles if t is not None and t.num_rows]
        held[:] = [] if last else table.slice(cut[-1]).to_batches()
        if found:
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            yield from out(pa.Table.from_batches([*held, batch]), False)
    if held:
        yield from out(pa.Table.from_batches(held), True)


def _with_partners(percent: int):
    """The rows of each tile that can have a link there, without their sketches."""

    def rows(tile: pa.Table) -> pa.Table:
        ok = possible(tile, tile.column("n").to_numpy(), _lists(tile, "sketch"), percent)
        return tile.filter(pa.array(ok.any(axis=0) | ok.any(axis=1))).drop_columns(["n", "sketch"])

    return lambda batches: _by_tile(batches, rows)


def _linked(shingle: int, percent: int):
    """A forest of the links of each tile, found on full sets."""

    def links(tile: pa.Table) -> pa.Table | None:
        sets = [shingle_set(t, shingle) for t in tile.column("t").to_pylist()]
        own = [set_mark(z, 1) == s for z, s in zip(sets, tile.column("s1").to_pylist(), strict=True)]  # an id can have more texts
        tile, sets = tile.filter(pa.array(own)), [z for z, good in zip(sets, own, strict=True) if good]
        if len(sets) < 2:
            return None
        sketches = [(_signed(z[:SKETCH]) >> 32).astype(np.int32) for z in sets]
        ok = possible(tile, np.array([len(z) for z in sets]), sketches, percent)
        keys = tile.column("rep").to_numpy()
        found = forest(ok, tile.column("component").to_numpy(), sets, percent)
        return pa.table({c: pa.array([keys[x[side]] for x in found], pa.int64()) for side, c in enumerate("ab")})

    return lambda batches: _by_tile(batches, links)


def link_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``k, n_shingles, component`` of each row: sets with ``100 * intersection >= percent * union`` are linked.

    ``k`` is the id with null as the smallest long, ``component`` the smallest ``k`` reachable by links. Null and
    empty texts have an empty set and no links; texts with fewer words than a shingle are one shingle. Rows of
    equal id count as one document that has the links of each. Repeated rows stay; an empty table gives
    none; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(key_of(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    sets = saved(rows.mapInArrow(_sets(shingle), "k long, n long, s1 long, s2 long, sketch array<long>"), "sets")
    reps = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("k").alias("rep"))
    members = saved(sets.select("k", "n", "s1", "s2").join(reps, ["n", "s1", "s2"], "left").select("k", "n", F.coalesce("rep", "k").alias("rep")), "members")
    first = reps.select(F.col("rep").alias("k"), "s1").distinct()
    sketches = sets.where("n > 0").join(first, ["k", "s1"], "left_semi").select(F.col("k").alias("rep"), "s1", "n", "sketch").dropDuplicates(["rep", "s1"])

    # inverted lists: values that several sets retain, rarest first, without the last q - 1 of each set
    values = sketches.select("rep", "s1", "n", F.explode(F.slice("sketch", 1, INDEX)).alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    q = F.when(F.col("n") * 100 <= INDEX * percent, F.ceil(F.col("n") * percent / 100)).otherwise(INDEX // 4)
    own = Window.partitionBy("rep", "s1")
    ranked = values.join(shared, "v").withColumns({"at": F.row_number().over(own.orderBy("c", "v")), "s": F.count("*").over(own)})
    lists = saved(ranked.where(F.col("at") <= F.col("s") - q + 1).select("v", "rep", "s1", "n"), "lists")
    sketches = saved(sketches.join(lists.select("rep", "s1").distinct(), ["rep", "s1"], "left_semi"), "sketches")
    texts = saved(rows.join(lists.select(F.col("rep").alias("k")).distinct(), "k", "left_semi").distinct(), "texts")
    release(spark)

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("k").alias(c), F.col("t").alias(f"t{c}"))
        return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ta", "tb").mapInArrow(_verify(shingle, percent), "a long, b long").distinct()

    fits = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    hubs = lists.groupBy("v").agg(F.min(F.struct("rep", "s1", "n")).alias("h"), F.count("*").alias("m")).where("m > 1")
    stars = lists.join(hubs, "v").where((F.col("rep") != F.col("h.rep")) & fits("n", "h.n")).select(F.col("h.rep").alias("a"), F.col("h.s1").alias("ma"), F.col("rep").alias("b"), F.col("s1").alias("mb")).distinct()
    side = lambda c: sketches.select(F.col("rep").alias(c), F.col("s1").alias(f"m{c}"), F.col("sketch").alias(f"s{c}"))
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    stars = stars.join(side("a"), ["a", "ma"]).join(side("b"), ["b", "mb"]).withColumns({"u": union, "i": F.array_intersect("sa", "sb")})
    stars = stars.where(F.size(F.array_intersect("i", "u")) >= ESTIMATE * F.size("u")).select("a", "b").distinct()
    same_id = members.join(members.groupBy("k").agg(F.min("rep").alias("b")), "k").where("rep <> b").select(F.col("rep").alias("a"), "b")
    found = saved(verified(stars).unionByName(same_id), "links")
    release(spark)

    components = connected_components(found)
    placed = lists.join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    upper = lambda c: F.transform(c, lambda x: F.shiftright(x, 32).cast("int")).alias(c)
    prefixes = lists.groupBy("rep", "s1").agg(F.collect_list("v").alias("prefix"))
    short = sketches.select("rep", "s1", "n", upper("sketch")).join(prefixes.select("rep", "s1", upper("prefix")), ["rep", "s1"])
    mixed = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m"), F.sum("n").alias("words")).where("lo <> hi")
    mixed = mixed.select("v", F.greatest(F.ceil(F.col("m") / TILE), F.ceil(F.col("words") / TILE_SHINGLES)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep", "s1", "v"), F.col("blocks")).cast("int")
    tiles = placed.join(mixed, "v").withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("v", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "s1", "component").join(short, ["rep", "s1"])
    # the upper half of a hash is enough to estimate by, and keeps the order
    together = lambda df: df.repartition("v", "lo", "hi").sortWithinPartitions("v", "lo", "hi")
    tiles = together(tiles.select("v", "lo", "hi", "own", "rep", "s1", "n", "component", "sketch", "prefix"))
    left = "v long, lo int, hi int, own int, rep long, s1 long, component long, prefix array<int>"
    rest = saved(tiles.mapInArrow(_with_partners(percent), left), "rest")
    release(spark)
    late = together(rest.join(texts.withColumnRenamed("k", "rep"), "rep").select(*rest.columns, "t")).mapInArrow(_linked(shingle, percent), "a long, b long")
    late = saved(late, "late")
    components = connected_components(found.unionByName(late))
    discard(sets, lists, sketches, texts, found, rest, late)
    nodes = components.select(F.col("node").alias("rep"), "component")
    return members.join(nodes, "rep", "left").select("k", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component"))
