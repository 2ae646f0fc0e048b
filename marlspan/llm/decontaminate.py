"""Benchmark decontamination: a prefix-filtered set join, verified exactly.

Every item gives windows of 13 consecutive words (an item of fewer words is one
window).  A window can only lie in a document that holds all of its shingles, so
its prefix, for containment 1, is its single rarest shingle, rarity being
the number of times the whole corpus holds it.  Documents are joined with the
prefixes; a match fixes where the window would have to begin, which bounds its
position and length within the text; then the words are compared one by one.

The prefix index is broadcast.  It comes from item blocks of at most
`max_index_bytes` of benchmark text and is a few arrays, about twenty bytes per byte of text: a larger benchmark is
joined block by block, each in passes of its own over all documents; the hits of a pass are written
down and its broadcast given back before the next one, and at the end the hits are united.

Defined results.  Null and empty texts have no words and no hits; null or empty
items give no window.  Equal items count each by its item_id; an item without an id hits but is not counted;
equal rows are each judged.  An empty benchmark leaves all documents clean, no documents give no rows.  Very
long texts are joined whole.  Columns other than those named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .cluster import cut, small_batches

WINDOW, SHINGLE = 13, 3
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


@dataclass
class Index:
    """Windows of items and the shingles to find them by, in arrays.

    raw, start, end: the items' text and its words; at, size, hash: first word, number of words and hash of each
    distinct window; owner[owner_first[w] : owner_first[w + 1]]: indices into names of the items that have window w;
    shingles: size -> (hash, window, offset), by hash: one for each window once prefixes() has chosen.
    """

    raw: bytes
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    owner_first: np.ndarray
    owner: np.ndarray
    names: list[str]
    shingle: int
    places: dict[int, np.ndarray] = field(default_factory=dict)
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], window: int, shingle: int) -> Index:
        buf, off = tk.text_buffer(pa.array([t for _, t in rows], pa.large_string()))
        low = tk.LOWER[buf]
        w = tk.Words(low, off, tk.NON_ALNUM)
        n = w.per_text()
        whole = np.flatnonzero((n > 0) & (n < window))
        at = np.concatenate([tk.window_starts(w.first, window), w.first[whole]]).astype(np.int64)
        size = np.concatenate([np.full(len(at) - len(whole), window), n[whole]]).astype(np.int64)
        item = np.searchsorted(w.first, at, "right") - 1
        sums = tk.sequence_sums(w.hash)
        # windows are told apart by two hashes of their words
        h = tk.sequence_hash(sums, at, size)
        other = tk.sequence_hash(tk.sequence_sums(tk.span_hash(tk.byte_sums(low, 2), w.start, w.end)), at, size)
        names = sorted({str(i) for i, _ in rows if i is not None})
        number = {s: k for k, s in enumerate(names)}
        name = np.array([-1 if i is None else number[str(i)] for i, _ in rows] or [-1])[item]
        order = np.lexsort((name, other, h, size))
        at, size, h, other, name = at[order], size[order], h[order], other[order], name[order]
        new = np.ones(len(at), bool)
        new[1:] = (size[1:] != size[:-1]) | (h[1:] != h[:-1]) | (other[1:] != other[:-1])
        own = name >= 0
        own[1:] &= new[1:] | (name[1:] != name[:-1])
        number_of = np.cumsum(new) - 1
        out = cls(low.tobytes(), w.start, w.end, at[new], size[new], h[new], np.zeros(0, np.int64), name[own], names, shingle)
        out.owner_first = np.searchsorted(number_of[own], np.arange(len(out.at) + 1))
        # the hash of the shingle at each word, by shingle size
        for k in np.unique(np.minimum(out.size, shingle)).tolist():
            hashes = np.zeros(len(w), np.uint64)
            hashes[: len(w) - k + 1] = tk.sequence_hash(sums, np.arange(len(w) - k + 1), k)
            out.places[k] = hashes
        return out

    def offsets(self, k: int):
        """For each offset: the windows that have a shingle of size k there, and its hashes."""
        mine = np.flatnonzero(np.minimum(self.size, self.shingle) == k)
        for o in range(int(self.size[mine].max()) - k + 1 if len(mine) else 0):
            some = mine[self.size[mine] >= o + k]
            yield o, some, self.places[k][self.at[some] + o]

    def distinct(self) -> dict[int, np.ndarray]:
        out = {}
        for k in self.places:
            found = np.zeros(0, np.uint64)
            for _, _, h in self.offsets(k):
                found = np.union1d(found, h)
            out[k] = found
        return out

    def prefixes(self, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> Index:
        """The rarest shingle of each window (ties: smaller hash, then earlier); what is needed for choosing goes."""
        out = replace(self, places={}, shingles={})
        for k in self.places:
            known, n = counts.get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            best = np.full(len(self.at), np.iinfo(np.int64).max)
            chosen, offset = np.full(len(self.at), ~np.uint64(0)), np.full(len(self.at), -1)
            for o, some, h in self.offsets(k):
                rarity = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rarity = np.where(known[at] == h, n[at], 0)
                good = (rarity < best[some]) | ((rarity == best[some]) & (h < chosen[some]))
                best[some[good]], chosen[some[good]], offset[some[good]] = rarity[good], h[good], o
            mine = np.flatnonzero(offset >= 0)
            mine = mine[np.argsort(chosen[mine], kind="stable")]
            out.shingles[k] = chosen[mine], mine, offset[mine]
        return out

    def same_words(self, window: int, low: bytes, start: np.ndarray, end: np.ndarray, begin: int) -> bool:
        a, n = int(self.at[window]), int(self.size[window])
        return all(low[start[begin + k] : end[begin + k]] == self.raw[self.start[a + k] : self.end[a + k]] for k in range(n))

    def items(self, window: int) -> list[str]:
        return [self.names[k] for k in self.owner[self.owner_first[window] : self.owner_first[window + 1]].tolist()]


def _occurrences(words: tk.Words, hashes: np.ndarray, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, index in the sorted hashes) of each place that holds one of the shingles."""
    n = len(words)
    if n < size or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = tk.sequence_hash(tk.sequence_sums(words.hash), np.arange(n - size + 1), size)
    maybe = np.flatnonzero(marks[(h >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(hashes, h[maybe])
    at[at == len(hashes)] = 0
    same = hashes[at] == h[maybe]
    return maybe[same], at[same]


def _marks(hashes: np.ndarray) -> np.ndarray:
    """Which values of the 20 top bits occur: most places of a text are passed over by it."""
    out = np.zeros(1 << 20, bool)
    out[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return out


def shingle_counts(docs: DataFrame, index: Index) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """size -> (shingles, ascending; how often the whole corpus holds each): at most as many as the index has."""
    sets = docs.sparkSession.sparkContext.broadcast(index.distinct())

    def run(batches):
        total = {size: np.zeros(len(h), np.int64) for size, h in sets.value.items()}
        marks = {size: _marks(h) for size, h in sets.value.items()}
        for b in batches:
            buf, off = tk.text_buffer(b.column(0))
            for i, j in tk.chunks(off):
                w = tk.Words(tk.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i], tk.NON_ALNUM)
                for size, h in sets.value.items():
                    _, at = _occurrences(w, h, size, marks[size])
                    total[size] += np.bincount(at, minlength=len(h))
        for size, h in sets.value.items():
            some = np.flatnonzero(total[size])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), size, np.int32)), pa.array(h[some].view(np.int64)), pa.array(total[size][some])], ["size", "shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "size int, shingle long, n long").groupBy("size", "shingle").agg(F.sum("n").alias("n")).toArrow()
    sets.unpersist()
    sizes, h, n = (rows.column(k).to_numpy() for k in range(3))
    out = {}
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        mine = mine[np.argsort(h[mine].view(np.uint64))]
        out[size] = h[mine].view(np.uint64), n[mine]
    return out


class Matcher:
    """Finds windows in texts by their prefixes."""

    def __init__(self, index: Index | None):
        self.index = index
        shingles = index.shingles if index else {}
        self.marks = {size: _marks(h) for size, (h, _, _) in shingles.items()}
        self.unique = {size: np.unique(h, return_index=True, return_counts=True) for size, (h, _, _) in shingles.items()}

    def find(self, words: tk.Words, low: bytes) -> list[tuple[int, int]]:
        """(first word, window) of every occurrence."""
        out = []
        text_of, sums = words.text_of(), tk.sequence_sums(words.hash)
        for size in self.unique:
            (hashes, first, count), (_, window, offset) = self.unique[size], self.index.shingles[size]
            places, at = _occurrences(words, hashes, size, self.marks[size])
            # every window of each prefix: where it would begin, and whether it lies within the text
            n = count[at]
            entry = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            place, w = np.repeat(places, n), window[entry]
            begin, length = place - offset[entry], self.index.size[w]
            text = text_of[place]
            inside = np.flatnonzero((begin >= words.first[text]) & (begin + length <= words.first[text + 1]))
            begin, w, length = begin[inside], w[inside], length[inside]
            same = np.flatnonzero(tk.sequence_hash(sums, begin, length) == self.index.hash[w])
            out += [(x, y) for x, y in zip(begin[same].tolist(), w[same].tolist()) if self.index.same_words(y, low, words.start, words.end, x)]
        return out

    def judge(self, buf: np.ndarray, off: np.ndarray):
        """Per text: words, hit words (a mask over the words), item ids."""
        low = tk.LOWER[buf]
        words = tk.Words(low, off, tk.NON_ALNUM)
        found = self.find(words, low.tobytes())
        marks, items = np.zeros(len(words) + 1, np.int64), {}
        text_of = words.text_of()
        for begin, w in found:
            marks[begin] += 1
            marks[begin + int(self.index.size[w])] -= 1
            items.setdefault(int(text_of[begin]), set()).update(self.index.items(w))
        return words, np.cumsum(marks[:-1]) > 0, items


def _item_blocks(benchmark: DataFrame, max_bytes: int):
    """The items, in blocks of at most max_bytes of text (a longer item is one block)."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode()) + 16
        if block and size + n > max_bytes:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, max_index_bytes: int = 8 << 20) -> DataFrame:
    """Hit words and items of each document, and whether it is contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    matchers = _matchers(docs, benchmark, window, shingle, max_index_bytes)
    matcher, more = next(matchers, (None, False))
    if more:
        return _by_passes(docs, matcher, matchers).drop("__key")
    matcher = matcher or spark.sparkContext.broadcast(None)

    def run(batches):
        m = Matcher(matcher.value)
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off):
                words, hit, items = m.judge(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n, hits = words.per_text(), tk.per_text_sum(hit, words.first)
                sets = [items.get(k, set()) for k in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array(n), pa.array(hits), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.string()), pa.array((hits > 0) & (20 * hits >= n))],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _matchers(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, max_index_bytes: int):
    """(a broadcast prefix index, whether there are more) of each block of items, one after another."""
    blocks = _item_blocks(benchmark, max_index_bytes)
    block = next(blocks, None)
    while block is not None:
        index = Index.build(block, window, shingle)
        index = index.prefixes(shingle_counts(docs, index))
        block = next(blocks, None)
        yield docs.sparkSession.sparkContext.broadcast(index), block is not None


def _by_passes(docs: DataFrame, matcher, rest) -> DataFrame:
    """One pass over the documents for each block of items; the hit words of all are united by the digest of the text."""
    keyed = docs.select("doc_id", "text", F.sha2(F.col("text"), 256).alias("__key"))

    def pass_(matcher):
        def run(batches):
            m = Matcher(matcher.value)
            for b in batches:
                buf, off = tk.text_buffer(b.column(0))
                for i, j in tk.chunks(off):
                    words, hit, items = m.judge(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    hits = tk.per_text_sum(hit, words.first)
                    rows = np.flatnonzero(hits)
                    places = [np.flatnonzero(hit[words.first[r] : words.first[r + 1]]).tolist() for r in rows]
                    yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i).take(pa.array(rows)), pa.array(places, pa.list_(pa.int64())), pa.array([sorted(items[int(r)]) for r in rows], pa.list_(pa.string()))], ["__key", "places", "items"])

        out = cut(keyed.select("text", "__key").mapInArrow(run, "__key string, places array<long>, items array<string>"))
        matcher.unpersist()
        return out

    hits = pass_(matcher)
    for m, _ in rest:
        hits = hits.unionByName(pass_(m))
    flat = F.flatten(F.collect_set("places"))
    hits = hits.groupBy("__key").agg(F.size(F.array_distinct(flat)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def count(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            n = [tk.Words(tk.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i], tk.NON_ALNUM).per_text() for i, j in tk.chunks(off)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), b.column(2)], ["doc_id", "n_words", "__key"])

    out = keyed.mapInArrow(count, "doc_id long, n_words long, __key string").join(hits, "__key", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "__key", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, max_index_bytes: int = 8 << 20) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    small_batches(docs.sparkSession)
    matchers = _matchers(docs, benchmark, WINDOW, SHINGLE, max_index_bytes)
    matcher, more = next(matchers, (None, False))
    if more:
        # by text: rows that share a doc_id are judged each by its own
        bad = _by_passes(docs.select("doc_id", "text"), matcher, matchers).where("contaminated").select(F.col("__key").alias("__bad")).distinct()
        return docs.join(bad, F.sha2(docs["text"], 256) == bad["__bad"], "left_anti")
    at, matcher = docs.columns.index("text"), matcher or docs.sparkSession.sparkContext.broadcast(None)

    def run(batches):
        m = Matcher(matcher.value)
        for b in batches:
            buf, off = tk.text_buffer(b.column(at))
            for i, j in tk.chunks(off):
                words, hit, _ = m.judge(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                n, hits = words.per_text(), tk.per_text_sum(hit, words.first)
                yield b.slice(i, j - i).filter(pa.array(~((hits > 0) & (20 * hits >= n))))

    return docs.mapInArrow(run, docs.schema)
