"""N-gram Jaccard join: token-combination prefixes, then exact verification.

A document is the set of its distinct word shingles.  All sets are ordered by one
global order, rare shingles first; of a set of n, at most e = n - ceil(t n)
shingles can be missing from a partner.  Shingles fall into classes by how
often the corpus holds them: rare ones are indexed singly (k = 1), frequent ones by
combinations of k = 2, very frequent ones of k = 3.  The frequent classes are cut further,
by hash, into groups of a few prefix shingles each, so that the combinations stay linear
in the prefix.  The prefix is extended until, summed over classes and groups, the
shingles beyond the first k - 1 exceed e: if two sets with enough overlap shared no
combination, each group could hold k - 1 common prefix shingles at most, and more than e
of the prefix would be missing from the partner.  So no pair is lost.

The order only has to be the same everywhere.  It comes from count-min sketches
of the whole corpus, one per partition, merged; their size is fixed, so they
can be broadcast.  The number of groups follows the size band of the smaller
set of a pair; a set that can be the larger one of a pair in the next lower band is
indexed in that band too.

Equal sets are one node.  Within a combination's nodes, each is verified against the
smallest; what then lies in one component needs no further check.  Of the nodes of a combination
that spans components, those outside its largest component are still to be met with the others.  All
combinations with the same largest component pool their nodes, so that nodes that share many
combinations meet once: in chunks of near sizes and in shares of fixed size.  No pairs are made.

Before texts are fetched, bit maps of the sets, two to four bits a shingle, bound every overlap from above: a bit that
one map has and the other has not is a shingle that is missing there.  Only nodes that some bound leaves a partner are
verified by their texts.

Defined results.  Null, empty and white-space texts have no shingles and are alone.
Fewer words than a shingle: the whole sequence is one.  Rows that share a doc_id are judged each by
its text; their sets share the name.  A null doc_id names nothing: such a row takes the component of an equal
set that has a name, else null.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .cluster import cut, small_batches
from .components import components


@dataclass(frozen=True)
class Params:
    """percent: of the union that two sets must share; sketch_cells: per row, two rows; chunk, probes: nodes on either side that meet at a time; broadcast_rows: of ids, some sixty bytes each, up to which they are broadcast."""

    words: int = 5
    percent: int = 80
    sketch_cells: int = 1 << 20
    small: int = 8
    chunk: int = 256
    probes: int = 512
    broadcast_rows: int = 200_000


def sets_of(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, ascending."""
    w = tk.Words(tk.LOWER[buf], off, tk.SPACE)
    counts = w.per_text()
    sums = tk.sequence_sums(w.hash)
    starts = tk.window_starts(w.first, words)
    text = np.repeat(np.arange(len(counts)), np.maximum(counts - words + 1, 0))
    h = tk.sequence_hash(sums, starts, words)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        h = np.concatenate([h, tk.sequence_hash(sums, w.first[short], counts[short])])
        text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(counts) + 1))


# ---- the global order ----


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(cells - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64) + cells


def _packed(counts: np.ndarray) -> bytes:
    # the counts of one task are small numbers: a byte or two each, and those alike
    return zlib.compress(counts.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32)


def _merge(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            one = _unpacked(raw)
            total[part] = total[part] + one if part in total else one
    for part, sums in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(sums)], pa.binary())], ["part", "counts"])


def shingle_sketch(docs: DataFrame, p: Params) -> np.ndarray:
    """Counts of both rows over the whole corpus, modulo 2**32, cells of a row side by side."""
    cells, part = p.sketch_cells, 1 << 17

    def run(batches):
        total = np.zeros(2 * cells, np.uint32)
        for b in batches:
            buf, off = tk.text_buffer(b.column(0))
            for i, j in tk.chunks(off):
                h, _ = sets_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                for at in _cells(h, cells):
                    np.add.at(total, at, np.uint32(1))
        for k in range(0, 2 * cells, part):
            yield pa.RecordBatch.from_arrays([pa.array([k // part], pa.int32()), pa.array([_packed(total[k : k + part])], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    partial = docs.select("text").mapInArrow(run, schema)
    # first sub-sums of each part, then the parts, as running sums: no task holds more than its sums
    merged = partial.withColumn("__s", F.spark_partition_id() % 16).repartition(24, "part", "__s").select("part", "counts").mapInArrow(_merge, schema)
    merged = merged.repartition(8, "part").mapInArrow(_merge, schema)
    out = np.zeros(2 * cells, np.uint32)
    for row in merged.collect():
        out[row.part * part : row.part * part + part] = _unpacked(row.counts)
    return out


@dataclass
class Order:
    """Estimated counts, and where the frequent classes begin."""

    counts: np.ndarray
    cells: int

    def __post_init__(self):
        load = int(self.counts[: self.cells].mean()) if len(self.counts) else 0
        # beyond what the other shingles of a cell explain
        self.frequent = load + 4 * int(load**0.5) + 16
        self.very_frequent = self.frequent + 15 * (self.frequent - load)

    def estimate(self, h: np.ndarray) -> np.ndarray:
        a, b = _cells(h, self.cells)
        return np.minimum(self.counts[a], self.counts[b])


# ---- signatures ----


def _group_ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): rows ordered by the keys, the first key first, and each one's rank among equals of all but the last."""
    order = np.lexsort(keys[::-1])
    n = len(order)
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys[:-1]:
            new[1:] |= k[order][1:] != k[order][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order, np.arange(n) - start


def signatures(h: np.ndarray, first: np.ndarray, order: Order, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text), distinct, of all sets."""
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    estimate = order.estimate(h)
    by = np.lexsort((h, estimate, text))
    h, estimate = h[by], estimate[by]
    position = np.arange(len(h)) - first[text]
    missing = sizes - -(-sizes * p.percent // 100)
    least = -(-sizes * p.percent // 100)
    rare = estimate < order.frequent
    n_rare = tk.per_text_sum(rare, first)
    # Small sets: every class singly.
    small = least < p.small
    take = small[text] & (position <= missing[text])
    out_h, out_t = [tk.mix(h[take] + np.uint64(1))], [text[take]]
    # Enough rare shingles: the prefix is the first e + 1, all single.
    large = sizes >= p.small
    plain = large & (n_rare > missing)
    take = plain[text] & (position <= missing[text])
    out_h.append(h[take])
    out_t.append(text[take])
    # The others, in the bands of the smallest partner and of their own size.
    rest = np.flatnonzero(large & ~plain)
    if len(rest):
        own = np.floor(np.log2(sizes[rest])).astype(np.int64)
        lower = np.floor(np.log2(np.maximum(least[rest], p.small))).astype(np.int64)
        for band_of in (own, lower):
            chosen = rest if band_of is own else rest[lower != own]
            band = np.zeros(len(sizes), np.int64)
            band[rest] = band_of
            s, t = _combined(h, estimate, text, np.isin(text, chosen), band, missing, order)
            out_h.append(s)
            out_t.append(t)
    sig, text = np.concatenate(out_h), np.concatenate(out_t)
    by = np.lexsort((sig, text))
    sig, text = sig[by], text[by]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (text[1:] != text[:-1])
    return sig[new], text[new]


def _combined(h, estimate, text, chosen, band, missing, order):
    """Signatures of the chosen rows' sets; rows come by text and global order."""
    h, estimate, text = h[chosen], estimate[chosen], text[chosen]
    k = 1 + (estimate >= order.frequent).astype(np.int64) + (estimate >= order.very_frequent)
    groups = np.maximum(1, (1 << band[text]) // np.array([1, 1, 16, 24])[k])
    group = np.where(k == 1, 0, tk.mix(h).astype(np.uint64) % groups.astype(np.uint64)).astype(np.int64)
    place = np.arange(len(h))
    by, rank = _group_ranks(text, k, group, place)
    counts = np.zeros(len(h), np.int64)
    counts[by] = rank >= k[by] - 1
    # the prefix ends where the counted shingles exceed e
    run = np.cumsum(counts)
    begin = np.searchsorted(text, text)
    before = np.where(begin > 0, run[begin - 1], 0)
    inside = (run - before - counts) <= missing[text]
    h, text, k, group, place, band = h[inside], text[inside], k[inside], group[inside], place[inside], band[text[inside]]
    by, rank = _group_ranks(text, k, group, place)
    h, text, k, band = h[by], text[by], k[by], band[by]
    single = k == 1
    out_h, out_t = [h[single]], [text[single]]
    longest = int(rank.max()) + 1 if len(rank) else 0
    n, salt = len(h), tk.mix(band.astype(np.uint64) + np.uint64(99))
    for d in range(1, longest):
        i = np.flatnonzero(rank[d:] >= d)  # i and i + d are of one group
        pair = i[k[i] == 2]
        out_h.append(tk.mix(h[pair] * np.uint64(3) + h[pair + d] + salt[pair]))
        out_t.append(text[pair])
        three = i[k[i] == 3]
        for d2 in range(d + 1, longest if len(three) else 0):
            t = three[three + d2 < n]
            t = t[rank[t + d2] >= d2]
            out_h.append(tk.mix(tk.mix(h[t] * np.uint64(3) + h[t + d] + salt[t]) + h[t + d2]))
            out_t.append(text[t])
    return np.concatenate(out_h), np.concatenate(out_t)


def document_signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n (set size), d1, d2 (a digest of the set), sigs, bits (a map of the set)."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(shingle_sketch(docs, p))

    def run(batches):
        order = Order(counts.value, p.sketch_cells)
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off):
                h, first = sets_of(buf[off[i] : off[j]], off[i : j + 1] - off[i], p.words)
                d1 = _sums(tk.mix(h), first)
                d2 = _sums(tk.mix(h * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(5)), first)
                sig, text = signatures(h, first, order, p)
                at = np.searchsorted(text, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(sig.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(d1), pa.array(d2), lists, bit_maps(h, first)], ["doc_id", "n", "d1", "d2", "sigs", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sigs array<long>, bits binary")


def bit_maps(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """A map of each set, of a power of two of bits: at least two for each shingle, 64 at least."""
    sizes = np.diff(first)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    begin = np.append(0, np.cumsum(width))
    flags = np.zeros(int(begin[-1]), bool)
    flags[np.repeat(begin[:-1], sizes) + (h & (np.repeat(width, sizes) - 1).astype(np.uint64)).astype(np.int64)] = True
    raw = np.packbits(flags, bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(begin // 8), pa.py_buffer(raw)]).cast(pa.binary())


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return (sums[first[1:]] - sums[first[:-1]]).view(np.int64)


# ---- verification ----


def _fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Maps (rows of 64-bit words) with their bits taken modulo that many words."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def partners(bits: list[bytes], n: np.ndarray, member: np.ndarray, probe: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members and which probes the bounds leave a partner."""
    words = np.array([len(x) // 8 for x in bits])
    of_width = {int(w): member[words[member] == w] for w in np.unique(words[member])}
    maps = {w: np.frombuffer(b"".join([bits[i] for i in rows.tolist()]), np.uint64).reshape(len(rows), w) for w, rows in of_width.items()}
    folded: dict[tuple[int, int], np.ndarray] = {}
    good_member, good_probe = np.zeros(len(n), bool), np.zeros(len(n), bool)
    for t in probe.tolist():
        w = int(words[t])
        own = np.frombuffer(bits[t], np.uint64)
        for other, rows in of_width.items():
            # sets of near sizes have maps of near widths: these are powers of two
            if percent * max(w, other) >= 200 * min(w, other):
                continue
            if other > w:
                if (other, w) not in folded:
                    folded[other, w] = _fold(maps[other], w)
                theirs, mine = folded[other, w], own
            else:
                theirs, mine = maps[other], own if other == w else _fold(own[None], other)[0]
            most = np.minimum(n[t] - np.bitwise_count(mine & ~theirs).sum(axis=1), n[rows] - np.bitwise_count(theirs & ~mine).sum(axis=1))
            good = rows[(100 * most >= percent * (n[t] + n[rows] - most)) & (rows != t)]
            good_member[good] = True
            good_probe[t] |= len(good) > 0
    return good_member, good_probe


def _possible(sets: DataFrame, roles: DataFrame, p: Params) -> DataFrame:
    """The roles that have a partner by the bounds of their maps."""
    percent = p.percent

    def run(group: pa.Table) -> pa.Table:
        member, probe = (np.flatnonzero(group.column(c).to_numpy()) for c in ("member", "probe"))
        good = partners(group.column("bits").to_pylist(), group.column("n").to_numpy(), member, probe, percent)
        some = np.flatnonzero(good[0] | good[1])
        flags = [pa.array(g[some].astype(np.int32)) for g in good]
        return pa.table([*(group.column(c).take(pa.array(some)) for c in ("comp", "part", "share", "node")), *flags], ["comp", "part", "share", "node", "member", "probe"])

    maps = sets.where("n > 0").select(F.col("doc_id").alias("node"), "n", "bits").join(roles, "node").select("comp", "part", "share", "node", "member", "probe", "n", "bits")
    return maps.groupBy("comp", "part", "share").applyInArrow(run, roles.select("comp", "part", "share", "node", "member", "probe").schema)


def _small(ids: DataFrame, p: Params) -> DataFrame:
    """The ids, to be broadcast if they are few: beyond that they are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= p.broadcast_rows else ids


def _verify(docs: DataFrame, sets: DataFrame, roles: DataFrame, p: Params) -> DataFrame:
    """Links (a, b) between the members and the probes of each group and share.

    roles: (comp, part, share, node, member, probe); a node can be both.  A group's members are at most about
    p.chunk, and so are the probes of a share, each of which has all members.  Texts travel, not sets: they are smaller.
    """
    roles = _small(cut(_possible(sets, _small(cut(roles), p), p)), p)
    words, percent = p.words, p.percent

    def run(group: pa.Table) -> pa.Table:
        member, probe = (np.flatnonzero(group.column(c).to_numpy()) for c in ("member", "probe"))
        node = group.column("node").to_numpy()
        out_a, out_b = [], []
        if len(member) and len(probe):
            h, first = sets_of(*tk.text_buffer(group.column("text")), words)
            size = np.diff(first)
            rows = np.repeat(np.arange(len(size)), size)
            # the members' shingles, each with its owner, in order of hash
            mine = np.flatnonzero(np.isin(rows, member))
            mine = mine[np.argsort(h[mine], kind="stable")]
            flat, owner = h[mine], rows[mine]
            for t in probe.tolist():
                s = h[first[t] : first[t + 1]]
                lo, n = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = n - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(size))
                good = np.flatnonzero((both > 0) & (node != node[t]) & (100 * both >= percent * (size + len(s) - both)))
                out_a += node[good].tolist()
                out_b += [int(node[t])] * len(good)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    texts = docs.select(F.col("doc_id").alias("node"), "text").join(roles, "node").select("comp", "part", "share", "node", "member", "probe", "text")
    return texts.groupBy("comp", "part", "share").applyInArrow(run, "a long, b long")


def _roles(members: DataFrame, probes: DataFrame, p: Params) -> DataFrame:
    """Roles of members and probes, (comp, part, node) each: the probes of a group are dealt into shares, each with all its members."""
    keys = ["comp", "part"]
    shares = probes.groupBy(*keys).agg(F.ceil(F.count("*") / p.probes).cast("int").alias("shares"))
    no, yes = F.lit(0), F.lit(1)
    dealt = probes.join(shares, keys).select(*keys, F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), "node", no.alias("member"), yes.alias("probe"))
    copied = members.join(shares, keys).select(*keys, F.explode(F.sequence(no, F.col("shares") - 1)).alias("share"), "node", yes.alias("member"), no.alias("probe"))
    return dealt.unionByName(copied).groupBy(*keys, "share", "node").agg(F.max("member").alias("member"), F.max("probe").alias("probe"))


# ---- the operator ----


def jaccard_components(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of documents."""
    p = params or Params()
    small_batches(docs.sparkSession)
    sets = cut(document_signatures(docs, p))
    key = ["n", "d1", "d2"]
    nodes = sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.any_value("sigs").alias("sigs")).where("node is not null")

    # Combinations that two nodes or more share, with the smallest of these.
    bucket = Window.partitionBy("sig")
    shared = nodes.select("node", "n", F.explode("sigs").alias("sig")).withColumns({"least": F.min(F.struct("node", "n")).over(bucket), "most": F.max("node").over(bucket)})
    shared = cut(shared.where("least.node < most").select("sig", "node", "n", "least"))
    stars = shared.where((F.col("node") != F.col("least.node")) & (100 * F.least("n", "least.n") >= p.percent * F.greatest("n", "least.n")))
    stars = stars.select(F.col("least.node").alias("comp"), F.struct(F.lit(0).alias("band"), F.lit(0).alias("k")).alias("part"), "node").distinct()
    links = cut(_verify(docs, sets, _roles(stars.select("comp", "part", F.col("comp").alias("node")).distinct(), stars, p), p))
    found = cut(components(links))
    more = cut(_across(docs, sets, shared, found, p))
    # what the second round has linked joins components of the first
    found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    # Back to the rows.
    classes = sets.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node")).join(found, "node", "left")
    classes = classes.select(*key, F.coalesce("component", "node").alias("component_id"))
    rows = sets.select("doc_id", *key).join(classes, key, "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _across(docs: DataFrame, sets: DataFrame, shared: DataFrame, found: DataFrame, p: Params) -> DataFrame:
    """Links between the components so far."""
    sizes = found.join(found.groupBy("component").agg(F.count("*").alias("weight")), "component")
    spread = shared.join(sizes, "node", "left").select("sig", "node", "n", F.coalesce("component", "node").alias("of"), F.coalesce("weight", F.lit(1)).alias("weight"))
    # Combinations that span components, with the largest one of each; their nodes, pooled by it.
    top = F.max(F.struct("weight", (-F.col("of")).alias("least"))).alias("top")
    spans = spread.groupBy("sig").agg(top, F.min("of").alias("low"), F.max("of").alias("high")).where("low < high").select("sig", (-F.col("top.least")).alias("comp"))
    pool = cut(spread.join(spans, "sig").groupBy("comp", "node").agg(F.any_value("n").alias("n"), F.any_value("of").alias("of")))
    # A pool of few nodes is one chunk; more are cut by size.
    counts = pool.groupBy("comp").agg(F.count("*").alias("pooled"))
    band = F.when(F.col("pooled") <= p.chunk, -1).otherwise(F.floor(F.log("n") / math.log(100 / p.percent))).cast("int")
    pool = pool.join(counts, "comp").select("comp", "node", "n", "of", band.alias("band"))
    bands = pool.groupBy("comp", "band").agg(F.ceil(F.count("*") / p.chunk).cast("int").alias("chunks"), F.min("n").alias("n_least"), F.max("n").alias("n_most"), F.min("of").alias("low"), F.max("of").alias("high"))
    near = (100 * F.col("n_most") >= p.percent * F.col("n")) & (100 * F.col("n") >= p.percent * F.col("n_least"))
    others = (F.col("low") != F.col("of")) | (F.col("high") != F.col("of"))
    meets = pool.where("of != comp").select("comp", "node", "n", "of").join(bands, "comp").where(near & others)
    probes = meets.select("comp", "node", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct("band", k.alias("k")))).alias("part"))
    chunk = F.struct("band", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("k"))
    members = pool.join(bands.select("comp", "band", "chunks"), ["comp", "band"]).select("comp", chunk.alias("part"), "node")
    return _verify(docs, sets, _roles(members, cut(probes), p), p)


def one_of_each(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The documents with the smallest doc_id of their component, all columns; rows that repeat a doc_id and its text stay once.

    Rows of one doc_id with different texts all stay: which of them to drop, their name cannot tell.
    """
    found = jaccard_components(docs, params)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    named = left.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    return named.unionByName(left.where("doc_id is null"))
