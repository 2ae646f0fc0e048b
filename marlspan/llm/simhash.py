"""SimHash near duplicates: fingerprints that differ in a few bits, found by vantage-point trees.

A text's fingerprint has a bit set where over half of its shingles' hashes have it.  Equal fingerprints are one node.  If two
fingerprints differ in at most three bits, one of their halves differs in at most one; so there is one tree for each half, and each is
searched with radius one: in 32 bits, few points lie that near to a boundary, in 64 bits and radius three most would.

A tree's nodes split by Hamming distance d to a vantage point: d <= mu inside, else outside.  Both shards of each pair follow from the triangle
inequality: a point outside with d <= mu + 1 also asks the inside, and on its way further down it takes every branch that its ball may touch
(d <= mu + 1 inside, d >= mu outside).  A pair of two home shards is met once, in the shard of the inner one.  The upper levels are made from a
bounded sample, and there are as many levels as the number of nodes asks for, so that shards keep their size; a level has one vantage point, of
candidates in the sample the one whose distances spread most within the nodes, and each node its own mu.  Where a node has no sample, mu is the median of
distances between random halves.

Within a shard the same splitting goes on until few are left, and these are compared in full.  A shard gives a spanning forest of its links, not
its pairs: what is linked already is not linked again.  A shard of many near fingerprints is cut into chunks of points and shares of askers.

Defined results.  Null, empty and white-space texts have fingerprint zero, which is linked like any other.  Fewer words than a shingle: the whole
sequence is one.  Rows that share a doc_id are judged each by its text.  A null doc_id names nothing: such a row takes the component of the
documents it is linked with, null if none has a name.  An empty table gives no rows.  Texts are read whole, whatever their length.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .bpe import spread
from .cluster import cut, small_batches
from .components import components


@dataclass(frozen=True)
class Params:
    """bits: that two fingerprints may differ in (up to three); shard: nodes of a shard, about; sample: nodes that the tree is made from, about; chunk, share: points and askers that meet at a time."""

    words: int = 3
    seed: int = 42
    bits: int = 3
    shard: int = 4096
    sample: int = 32768
    candidates: int = 48
    chunk: int = 8192
    share: int = 32768


# ---- fingerprints ----


def shingle_texts(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text): the shingles of each text, in order, as ranges of the words joined by spaces."""
    w = tk.Words(tk.LOWER[buf], off, tk.SPACE)
    size = w.end - w.start + 1
    at = np.cumsum(size) - size
    joined = np.append(w.buf, 32)[spread(w.start, size)].astype(np.uint8)
    joined[at + size - 1] = 32
    counts = w.per_text()
    starts = tk.window_starts(w.first, words)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    last = starts + words - 1
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        starts, last, text = np.concatenate([starts, w.first[short]]), np.concatenate([last, w.first[short + 1] - 1]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        starts, last, text = starts[order], last[order], text[order]
    return joined.tobytes(), at[starts], (at + size - 1)[last], text


def fingerprints(buf: np.ndarray, off: np.ndarray, p: Params) -> np.ndarray:
    """The fingerprint of each text."""
    raw, start, end, text = shingle_texts(buf, off, p.words)
    n = len(off) - 1
    ones, step, seed, digest = np.zeros((n, 64), np.int64), 1 << 16, p.seed, xxhash.xxh64_intdigest
    for at in range(0, len(start), step):
        spans = zip(start[at : at + step].tolist(), end[at : at + step].tolist())
        h = np.array([digest(raw[i:j], seed) for i, j in spans], "<u8")
        of = text[at : at + step]
        new = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        flags = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[of[new]] += np.add.reduceat(flags, new, axis=0, dtype=np.int64)
    majority = 2 * ones > np.bincount(text, minlength=n)[:, None]
    return np.packbits(majority, axis=1, bitorder="little").reshape(-1).view("<u8")


def document_fingerprints(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, fp of each row."""

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off):
                fp = fingerprints(buf[off[i] : off[j]], off[i : j + 1] - off[i], p)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ---- the trees ----


def half(fp: np.ndarray, tree: int) -> np.ndarray:
    return (fp >> np.uint64(32 * tree)).astype(np.uint32)


@dataclass
class Tree:
    """Of one half: a vantage point for each level, and the mu of each node, level by level from 2**level on."""

    vantage: np.ndarray
    mu: np.ndarray
    radius: int

    @classmethod
    def of(cls, sample: np.ndarray, levels: int, radius: int, candidates: int) -> Tree:
        rng = np.random.default_rng(len(sample) + levels)
        vantage, mu = np.zeros(levels, np.uint32), np.full(1 << levels, 15, np.int8)
        node = np.ones(len(sample), np.int64)
        for level in range(levels):
            some = sample[rng.permutation(len(sample))[:candidates]] if len(sample) >= 8 << level else rng.integers(0, 1 << 32, 1, dtype=np.uint32)
            best = -1.0
            for v in some:
                d = np.bitwise_count(sample ^ v).astype(np.int64)
                n, sums, squares = (np.bincount(node, w, minlength=2 << level) for w in (None, d, d * d))
                within = float((squares - sums * sums / np.maximum(n, 1)).sum())
                if within > best:
                    best, vantage[level] = within, v
            d = np.bitwise_count(sample ^ vantage[level]).astype(np.int64)
            # the mu of each node that leaves nearest to half of its sample inside
            table = np.bincount((node - (1 << level)) * 34 + d, minlength=34 << level).reshape(-1, 34)
            sampled = np.flatnonzero(table.sum(axis=1) >= 8)
            inside = np.cumsum(table[sampled], axis=1)
            mu[(1 << level) + sampled] = np.abs(2 * inside - inside[:, -1:]).argmin(axis=1)
            node = 2 * node + (d > mu[node])
        return cls(vantage, mu, radius)

    def shards(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): where each point lives, and the shards it asks besides."""
        row, node, home = np.arange(len(x)), np.ones(len(x), np.int64), np.ones(len(x), bool)
        for v in self.vantage:
            d, mu = np.bitwise_count(x[row] ^ v).astype(np.int64), self.mu[node].astype(np.int64)
            # a home takes one side and, from the outside, asks the inside; one that asks takes all sides it may touch
            inward = np.where(home, d <= mu, d <= mu + self.radius)
            outward = np.where(home, d > mu, d > mu - self.radius)
            asks = home & (d > mu) & (d <= mu + self.radius)
            row = np.concatenate([row[inward], row[outward], row[asks]])
            node = np.concatenate([2 * node[inward], 2 * node[outward] + 1, 2 * node[asks]])
            home = np.concatenate([home[inward], home[outward], np.zeros(int(asks.sum()), bool)])
        return row, node, home


class Forest:
    """Components of n points, merged link by link."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, rows: np.ndarray, columns: np.ndarray, linked: np.ndarray) -> None:
        """Merge along linked[i, j] of points rows[i] and columns[j]: in each round every row takes one link to another component."""
        while True:
            cross = linked & (self.label[rows][:, None] != self.label[columns])
            some = np.flatnonzero(cross.any(axis=1))
            if not len(some):
                return
            a, b = self.label[rows[some]], self.label[columns[cross[some].argmax(axis=1)]]
            least: dict[int, int] = {}

            def find(x: int) -> int:
                while x in least:
                    x = least[x]
                return x

            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    least[max(x, y)] = min(x, y)
            to = np.arange(len(self.label))
            for x in list(least):
                to[x] = find(x)
            self.label = to[self.label]


#: Points that are compared in full.
FEW = 256


def _meet(forest: Forest, fp: np.ndarray, part: np.ndarray, points: np.ndarray, askers: np.ndarray, p: Params, radius: int) -> None:
    """Link each asker with the points within p.bits of it; part: of the half that the tree is of.  A vantage-point split where points are many."""
    todo = [(points, askers)]
    while todo:
        points, askers = todo.pop()
        if not len(points) or not len(askers):
            continue
        if len(points) > FEW and len(askers) > 8:
            v = part[points[len(points) // 2]]
            d = np.bitwise_count(part[points] ^ v)
            mu = int(np.median(d))
            if mu == d.max():
                mu -= 1
            if mu >= d.min():
                e = np.bitwise_count(part[askers] ^ v).astype(np.int64)
                todo += [(points[d <= mu], askers[e <= mu + radius]), (points[d > mu], askers[e > mu - radius])]
                continue
        for i in range(0, len(askers), FEW):
            rows = askers[i : i + FEW]
            for k in range(0, len(points), 2 * FEW):
                columns = points[k : k + 2 * FEW]
                forest.link(rows, columns, np.bitwise_count(fp[rows][:, None] ^ fp[columns]) <= p.bits)


def shard_links(fp: np.ndarray, point: np.ndarray, asks: np.ndarray, tree: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between points and askers, as pairs of fingerprints."""
    forest = Forest(len(fp))
    _meet(forest, fp, half(fp, tree), np.flatnonzero(point), np.flatnonzero(asks), p, p.bits // 2)
    some = np.flatnonzero(forest.label != np.arange(len(fp)))
    return fp[some], fp[forest.label[some]]


def links(nodes: DataFrame, p: Params) -> DataFrame:
    """(a, b): links between the distinct fingerprints fp that connect what is linked."""
    n = nodes.count()
    levels = max(0, int(np.ceil(np.log2(max(1, n) / p.shard))))
    of = max(1, n // p.sample)
    sample = np.array([r.fp for r in nodes.where(F.pmod(F.xxhash64("fp"), F.lit(of)) == 0).select("fp").collect()], np.int64).view(np.uint64)
    trees = [Tree.of(half(np.sort(sample), t), levels, p.bits // 2, p.candidates) for t in (0, 1)]

    def deal(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(trees):
                row, shard, home = tree.shards(half(fp, t))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(shard.astype(np.int32)), pa.array(home), pa.array(fp[row].view(np.int64))], ["tree", "shard", "home", "fp"])

    dealt = nodes.select("fp").mapInArrow(deal, "tree int, shard int, home boolean, fp long")
    key = ["tree", "shard"]
    sizes = dealt.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("points"), F.count("*").alias("askers")).where("points > 0")
    big = cut(sizes.where((F.col("points") > p.chunk) | (F.col("askers") > p.share)).select(*key, F.ceil(F.col("points") / p.chunk).cast("int").alias("chunks"), F.ceil(F.col("askers") / p.share).cast("int").alias("shares")))
    meets = dealt.select(*key, "fp", F.col("home").alias("point"), F.lit(True).alias("asks"), F.lit(0).alias("chunk"), F.lit(0).alias("share"))
    if not big.isEmpty():
        few = F.broadcast(big) if big.count() <= 100_000 else big
        split = dealt.join(few, key)
        chunk, share = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("shares")).cast("int")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        points = split.where("home").select(*key, "fp", F.lit(True).alias("point"), F.lit(False).alias("asks"), chunk.alias("chunk"), every("shares").alias("share"))
        askers = split.select(*key, "fp", F.lit(False).alias("point"), F.lit(True).alias("asks"), every("chunks").alias("chunk"), share.alias("share"))
        meets = meets.join(few.select(*key), key, "left_anti").unionByName(points).unionByName(askers)

    def run(group: pa.Table) -> pa.Table:
        # one fingerprint may be a point and ask
        fp, at = np.unique(group.column("fp").to_numpy().view(np.uint64), return_inverse=True)
        point, asks = np.zeros(len(fp), bool), np.zeros(len(fp), bool)
        point[at[group.column("point").to_numpy()]] = True
        asks[at[group.column("asks").to_numpy()]] = True
        a, b = shard_links(fp, point, asks, group.column("tree")[0].as_py(), p)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return meets.groupBy(*key, "chunk", "share").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of documents."""
    p = params or Params()
    if not 0 <= p.bits <= 3:
        raise ValueError("two halves tell fingerprints of up to three differing bits")
    small_batches(docs.sparkSession)
    rows = cut(document_fingerprints(docs, p))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, p))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp").select("fp", "component", "least")
    ids = named.join(named.groupBy("component").agg(F.min("least").alias("id")), "component").select("fp", "id")
    classes = nodes.join(ids, "fp", "left").select("fp", F.coalesce("id", "least").alias("component_id"))
    out = rows.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
