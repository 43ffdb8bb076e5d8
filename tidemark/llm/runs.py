"""Periodic runs of words, by suffix trees.

A run is a stretch that repeats with a smallest period and can't be extended. Every run has, for one of two orders of
the words (an order and its reverse), a Lyndon root that is the longest Lyndon word at its start. So the longest Lyndon
words at all places, under both orders, are all the candidates; each is extended as far as its period holds, to the
right by the longest common extension of two suffixes and to the left by that of two prefixes. Both come from
suffix trees (Ukkonen's construction) of the words and of their reversal: the extension of two leaves is the depth of
their lowest common ancestor, the least depth between them on the Euler tour, found in constant time.

Words of a run that is long enough have a copy of their neighbourhood nearby, so trees are built for the stretches of
a text in which every word lies in a repeated group of ``GRAM`` words. This leaves no run out: see :func:`stretches`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import begin_task, mix64, small_batches
from .importance import free_name

#: A run is reported if it has this many words, and this many periods, or more.
MIN_WORDS, MIN_PERIODS = 24, 3
#: Least length of repeated word groups; at most a third of MIN_WORDS.
GRAM = 8
#: Bytes of text that a task looks at together.
BUFFER = 1 << 20
FAR = 1 << 60
#: Words whose suffix trees are toured together; a longer stretch has a tour of its own.
FOREST = 30_000
#: Places of an Euler tour in one block of the minimum table.
BLOCK = 16


def suffix_tree(symbols: list[int]) -> tuple[dict[int, int], int, list[int]]:
    """The suffix tree of positive integers and an end mark (0), by Ukkonen's algorithm: children, width, inner depths.

    Node ``j`` below ``n`` (the length with the end mark) is the leaf of suffix ``j``; node ``n`` is the root, later ones
    are inner nodes, whose depths (the lengths of their strings) are given from the root on. The children map
    ``node * width + symbol`` to a node.
    """
    s = [*symbols, 0]
    n = len(s)
    width = max(s) + 1
    root = inner_nodes = n
    child: dict[int, int] = {}
    first, last, link, depth = [0] * (2 * n), [n] * (2 * n), [root] * (2 * n), [0]  # a node's edge is s[first:last]
    node, edge, length, leaf = root, 0, 0, 0  # the active point, and the next suffix to insert
    for i, c in enumerate(s):
        waiting = 0  # the inner node that waits for its suffix link
        while leaf <= i:
            key = node * width + (s[edge] if length else c)
            to = child.get(key)
            if to is None:
                child[key] = leaf
                first[leaf] = i
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                at = first[to]
                if length:
                    span = last[to] - at
                    if length >= span and to > n:
                        edge += span
                        length -= span
                        node = to
                        continue
                else:
                    edge = i
                at += length
                if s[at] == c:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                inner_nodes += 1
                child[key] = inner_nodes
                first[inner_nodes], last[inner_nodes] = first[to], at
                depth.append(i - leaf)
                first[to] = at
                child[inner_nodes * width + s[at]] = to
                child[inner_nodes * width + c] = leaf
                first[leaf] = i
                if waiting:
                    link[waiting] = inner_nodes
                waiting = inner_nodes
            leaf += 1
            if node != root:
                node = link[node]
            elif length:
                length -= 1
                edge = i - length
    return child, width, depth


class Extensions:
    """Longest common extensions within each of several sequences, from an Euler tour of their suffix trees.

    The tour's successors are linked up and ranked by doubling. The least depth between two places comes in constant
    time: within blocks by running minima from both ends, over blocks by a table of powers of two.
    """

    def __init__(self, sequences: list[list[int]]) -> None:
        sizes = np.array([len(s) + 1 for s in sequences], np.int64)
        parents, nodes, symbols, depths, roots, ends, base = [], [], [], [], [], [], 0
        for s, n in zip(sequences, sizes.tolist(), strict=True):
            child, width, inner = suffix_tree(s)
            key = np.fromiter(child.keys(), np.int64, len(child))
            parents.append(key // width + base)
            symbols.append(key % width)
            nodes.append(np.fromiter(child.values(), np.int64, len(child)) + base)
            depths += (np.arange(n, 0, -1), np.array(inner, np.int64))
            roots.append(base + n)
            ends.append(base)
            base += n + len(inner)
        parent, node, depth = np.concatenate(parents), np.concatenate(nodes), np.concatenate(depths)
        order = np.lexsort((np.concatenate(symbols), parent))
        parent, node = parent[order], node[order]
        up = np.zeros(base, np.int64)
        up[node] = parent
        # step v goes down to node v, step base + v goes up from it
        head = np.r_[True, parent[1:] != parent[:-1]]
        after = np.arange(base, 2 * base)
        after = np.concatenate([after, base + up])
        after[parent[head]] = node[head]
        sibling = np.flatnonzero(~head)
        after[base + node[sibling - 1]] = node[sibling]
        roots = np.array(roots)
        after[base + roots] = np.r_[roots[1:], base + roots[-1]]  # from tree to tree
        rank = (after != np.arange(2 * base)).astype(np.int64)
        jump = after
        for _ in range(int(2 * base).bit_length()):
            rank += rank[jump]
            jump = jump[jump]
        place = rank[roots[0]] - rank
        tour = np.empty(2 * base, np.int32)
        tour[place[:base]] = depth
        tour[place[base:]] = np.where(np.isin(np.arange(base), roots), 0, depth[up])
        self.first = np.r_[0, np.cumsum(sizes)]
        #: Places of all sequences' suffixes on the tour, which are their ranks as well.
        self.place = place[np.concatenate([np.arange(e, e + n) for e, n in zip(ends, sizes.tolist(), strict=True)])]
        rows = np.concatenate([tour, np.full(-len(tour) % BLOCK, np.iinfo(np.int32).max, np.int32)]).reshape(-1, BLOCK)
        self.depth = rows.ravel()
        self.upto = np.minimum.accumulate(rows, axis=1).ravel()
        self.onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while 2 << (len(self.table) - 1) <= len(rows):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the different suffixes ``i`` and ``j`` (numbered over all sequences) share from their starts on."""
        a, b = self.place[i], self.place[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        block_a, block_b = a // BLOCK, b // BLOCK
        out = np.minimum(self.onward[a], self.upto[b])
        gap = block_b - block_a - 1
        power = np.frexp(np.maximum(gap, 1))[1] - 1
        for p in np.unique(power[gap > 0]).tolist():
            at = np.flatnonzero((gap > 0) & (power == p))
            t = self.table[p]
            out[at] = np.minimum(out[at], np.minimum(t[block_a[at] + 1], t[block_b[at] - (1 << p)]))
        near = np.flatnonzero(block_a == block_b)
        a, b = a[near], b[near]
        least = self.depth[a]
        for step in range(1, BLOCK):
            least = np.minimum(least, self.depth[np.minimum(a + step, b)])
        out[near] = least
        return out.astype(np.int64)


def longest_lyndon(rank: list[int]) -> tuple[list[int], list[int]]:
    """The lengths of the longest Lyndon words at each place, in the order of ``rank`` and in its reverse.

    Each ends before the next suffix of smaller (greater) rank; the last suffix is the end mark alone.
    """
    n = len(rank)
    small, great, low, high = [0] * n, [0] * n, [], []
    for i in range(n - 1, -1, -1):
        r = rank[i]
        while low and rank[low[-1]] > r:
            low.pop()
        while high and rank[high[-1]] < r:
            high.pop()
        small[i] = (low[-1] if low else n) - i
        great[i] = (high[-1] if high else n) - i
        low.append(i)
        high.append(i)
    return small, great


def runs_of(sequences: list[list[int]], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[np.ndarray]:
    """For each sequence of positive symbols, rows ``start, length, period`` of all runs that are long enough, by start, then period."""
    ahead, back = Extensions(sequences), Extensions([s[::-1] for s in sequences])
    cuts = ahead.first
    of = np.repeat(np.arange(len(sequences)), np.diff(cuts))
    ranks = ahead.place.tolist()
    periods = [longest_lyndon(ranks[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    found = []
    for k in (0, 1):
        period = np.concatenate([np.array(p[k], np.int64) for p in periods])
        i = np.arange(len(period))
        size = np.diff(cuts)[of] - 1
        at = i - cuts[of]
        use = (at + period < size) & (min_periods * period <= size)
        i, period, at, size, start, seq = i[use], period[use], at[use], size[use], cuts[of[use]], of[use]
        right = ahead.common(i, i + period)
        # a reversed suffix from size - x on holds the words before place x
        left = np.zeros(len(i), np.int64)
        inner = at > 0
        mirrored = (start + size - at)[inner]
        left[inner] = back.common(mirrored, mirrored - period[inner])
        length = left + period + right
        ok = (length >= min_words) & (length >= min_periods * period)
        found.append(np.stack([seq[ok], (at - left)[ok], length[ok], period[ok]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return [rows[a:b, 1:] for a, b in zip(*(np.searchsorted(rows[:, 0], np.arange(len(sequences)), side) for side in ("left", "right")), strict=True)]


def stretches(ids: np.ndarray, doc: np.ndarray, gram: int = GRAM, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int]]:
    """Stretches ``[a, b)`` of ``min_words`` words or more within a document whose words all lie in repeated groups.

    In a run of ``length >= max(min_words, 3 * period)`` words, the group of ``gram <= min_words / 3`` words at any of its
    places has an equal one a period earlier or later within the run (if neither fits, the length is below
    ``2 * period + gram``), so the whole run is in one stretch, and as wide in it as in the document. A period is at most
    a third of the stretch, so groups whose nearest equal lies farther away are taken out, again and again. Groups are
    told by hashes; an accident only makes a stretch longer.
    """
    n = len(ids) - gram + 1
    if n <= 0:
        return
    h = np.zeros(n, np.uint64)
    value = mix64(ids.astype(np.uint64) + np.uint64(1))
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + value[j : n + j]
    h = mix64(h + mix64(doc[:n].astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    near = np.full(n, FAR)  # the distance of the nearest equal group
    step = np.diff(order)[same]
    near[order[1:][same]] = step
    near[order[:-1][same]] = np.minimum(near[order[:-1][same]], step)
    at = np.flatnonzero((near < FAR) & (doc[:n] == doc[gram - 1 :]))
    while len(at):
        # groups that overlap or touch, in one document
        new = np.flatnonzero(np.r_[True, (np.diff(at) > gram) | (np.diff(doc[at]) != 0)])
        first, size = at[new], at[np.r_[new[1:] - 1, len(at) - 1]] + gram - at[new]
        members = np.diff(np.r_[new, len(at)])
        can = np.repeat(size >= min_words, members) & (near[at] * 3 <= np.repeat(size, members))
        if can.all():
            yield from zip(first.tolist(), (first + size).tolist(), strict=True)
            return
        at = at[can]


def text_runs(texts: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text and its runs."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    ids = np.empty(int(sizes.sum()), np.int64)
    at = 0
    for w in words:
        known: dict[bytes, int] = {}
        ids[at : at + len(w)] = [known.setdefault(x, len(known)) for x in w]
        at += len(w)
    doc, first = np.repeat(np.arange(len(words)), sizes), np.r_[0, np.cumsum(sizes)]
    none = np.empty((0, 3), np.int64)
    found = [[none] for _ in words]

    def search(group: list[tuple[int, int]]) -> None:
        dense = [(np.unique(ids[a:b], return_inverse=True)[1] + 1).tolist() for a, b in group]
        for (a, _), rows in zip(group, runs_of(dense, min_words, min_periods), strict=True):
            found[doc[a]].append(rows + [a - first[doc[a]], 0, 0])

    group, size = [], 0
    for a, b in stretches(ids, doc, min(GRAM, min_words // 3), min_words):
        group.append((a, b))
        size += b - a
        if size >= FOREST:
            search(group)
            group, size = [], 0
    if group:
        search(group)
    return [(w, np.concatenate(f)) for w, f in zip(words, found, strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but for those that a run holds after its first period, joined by single spaces."""
    if not len(runs):
        return b" ".join(words)
    delta = np.zeros(len(words) + 1, np.int64)
    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
    np.add.at(delta, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(delta[:-1]) == 0)])


def find_runs(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """All columns of ``docs`` and ``runs`` (array of ``start, length, period`` by start, then period), ``collapsed`` (text).

    Words are ``[^\\x20\\x09-\\x0D]+``; a run has at least ``min_words`` words and ``min_periods`` (3 or more) periods. Null
    and empty texts have no runs and an empty ``collapsed``; a text without a run keeps all its words. Long texts are
    searched whole; runs that overlap or share a start are all given. Repeated rows stay and get the same result. Input
    columns of those two names are replaced; an empty table stays empty.
    """
    if min_periods < 3 or min_words < 3:
        raise ValueError("a run has at least 3 periods and 3 words")
    small_batches(docs.sparkSession)

    @F.arrow_udf("runs array<struct<start long, length long, period long>>, collapsed string")
    def search(texts: pa.Array) -> pa.Array:
        begin_task("runs")
        offsets, rows, kept = [0], [], []

        def take(group: list[bytes]) -> None:
            for words, found in text_runs(group, min_words, min_periods):
                rows.append(found)
                offsets.append(offsets[-1] + len(found))
                kept.append(collapsed(words, found).decode())

        group, size = [], 0
        for text in texts.cast(pa.binary()).to_pylist():
            group.append(text or b"")
            size += len(group[-1])
            if size >= BUFFER:
                take(group)
                group, size = [], 0
        take(group)
        every = np.concatenate([np.empty((0, 3), np.int64), *rows])
        structs = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], names=["start", "length", "period"])
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(kept, pa.string())], names=["runs", "collapsed"])

    own = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    name = free_name(docs, "_runs")
    made = docs.withColumn(name, search(F.col(f"`{text_col}`").cast("string")))
    return made.select(*[F.col(f"`{c}`") for c in own], f"{name}.runs", f"{name}.collapsed")


def strongest(runs: Column) -> Column:
    """The run of greatest exact ``length / period`` of an array; of equal ones the first."""
    better = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda best, x: F.when(better(best, x), x).otherwise(best))


def listed(runs: Column) -> Column:
    """Runs as lines ``start,length,period``."""
    return F.concat_ws("", F.transform(runs, lambda x: F.concat_ws("", F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))))


def made_periodic(id_col: str, text_col: str) -> Column:
    """The text, or for one id in ten its words with all from some word on repeating with some period (a fixed rule of the id's CRC-32); a null id leaves the text."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n, h = F.size(words), F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), 1, n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(F.col(text_col))
