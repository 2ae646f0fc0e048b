"""Exact removal of repeated passages, behind a count-min prefilter.

A window is `length` consecutive words of one document.  Equal windows hold the same least
`gram`-word hash, their anchor, so no window occurs more often than its anchor.  Documents are
dealt into blocks.  Each block makes a sketch of its anchors' counts (two rows of cells, cut into
slices by hash); slices are merged over all blocks, and a block is told which of its cells
are counted twice or more.  A count-min never counts too little, so a window whose
anchor's cells are not both among them is unique and is let go; none that repeats is lost.
The second pass sends the others, one row per block and distinct window, with a
96-bit digest, to exact grouping; the blocks are told which of their windows first start elsewhere.

The number of slices follows the text, so the share of needless candidates does not grow.
A window that many documents share is one row per block, not one per occurrence.

Defined results.  Null, empty and short texts have no windows and keep all words; kept text is
the kept words joined by one space.  "Earlier" is by doc_id (null ids first), then
start; rows that share a doc_id are not earlier than each other at the same start, so
repeated rows all keep what one of them would.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk
from .cluster import in_blocks, small_batches, text_bytes


@dataclass(frozen=True)
class Params:
    """block_bytes: text in a block; slice_bytes: text that adds one slice; cells: of a slice, per row."""

    length: int = 20
    gram: int = 8
    block_bytes: int = 6 << 20
    slice_bytes: int = 24 << 20
    cells: int = 1 << 24


class Windows:
    """The windows of a block's documents, which are put in the order of their ids.

    Words are cut and hashed some texts at a time; what stays is a few numbers per word.
    """

    def __init__(self, table: pa.Table, p: Params, digests: bool = True):
        ids = table.column("doc_id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
        self.ids = [ids[k] for k in self.order]
        self.buf, off = tk.text_buffer(table.column("text").combine_chunks().take(pa.array(self.order, pa.int64())))
        starts, ends, hashes, others, counts = [], [], [], [], []
        for i, j in tk.chunks(off):
            w = tk.Words(self.buf[off[i] : off[j]], off[i : j + 1] - off[i], tk.SPACE)
            starts.append(w.start + off[i])
            ends.append(w.end + off[i])
            hashes.append(w.hash)
            counts.append(w.per_text())
            if digests:
                others.append(tk.mix(tk.span_hash(tk.byte_sums(w.buf, 2), w.start, w.end) + np.uint64(3)))
        self.first = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
        self.word_start, self.word_end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.sums = tk.sequence_sums(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64))
        self.other_sums = tk.sequence_sums(np.concatenate(others)) if others else None
        self.start = tk.window_starts(self.first, p.length)
        self.p = p

    def __len__(self) -> int:
        return len(self.word_start)

    def text_of_window(self) -> np.ndarray:
        return np.searchsorted(self.first, self.start, "right") - 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the least hash of its grams, and the first place of that in the block."""
        p, n = self.p, len(self)
        if not len(self.start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        low = tk.sequence_hash(self.sums, np.arange(n - p.gram + 1), p.gram)
        place, need, span = np.arange(len(low)), p.length - p.gram + 1, 1

        def least(i, j):
            right = low[j] < low[i]
            return np.where(right, low[j], low[i]), np.where(right, place[j], place[i])

        while 2 * span <= need:
            low, place = least(slice(0, len(low) - span), slice(span, None))
            span *= 2
        return least(self.start, self.start + need - span)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the rank of its document's id, equal for equal ids, and its start there."""
        new = np.array([k > 0 and i != self.ids[k - 1] for k, i in enumerate(self.ids)], bool)
        text = self.text_of_window()
        return np.cumsum(new)[text], self.start - self.first[text]

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window."""
        other = tk.sequence_hash(self.other_sums, self.start, self.p.length)
        return tk.sequence_hash(self.sums, self.start, self.p.length), (other >> np.uint64(32)).astype(np.uint32)


def _cells(anchor: np.ndarray, slices: int, p: Params):
    """(slice, cell) of both rows."""
    for row, h in enumerate((anchor, tk.mix(anchor + np.uint64(17)))):
        h = tk.mix(h)
        yield (h % np.uint64(slices)).astype(np.int64), ((h >> np.uint64(32)).astype(np.int64) & (p.cells - 1)) + row * p.cells


def _sketch(table: pa.Table, slices: int, p: Params) -> pa.Table:
    """The block's sketch: of each slice the cells touched, and how many of these, first in the list, twice or more."""
    anchors, places = Windows(table, p, digests=False).anchors()
    block = table.column("__block")[0].as_py()
    anchor, count = np.unique(anchors[np.r_[True, places[1:] != places[:-1]]] if len(anchors) else anchors, return_counts=True)
    twice = count > 1
    keys, flags = [], []
    for s, c in _cells(anchor, slices, p):
        keys.append(s * (2 * p.cells) + c)
        flags.append(twice)
    key, flag = np.concatenate(keys), np.concatenate(flags)
    by = np.argsort(key, kind="stable")
    key, flag = key[by], flag[by]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    many = np.add.reduceat(1 + flag.astype(np.int64), first) > 1 if len(first) else np.zeros(0, bool)
    key = key[first]
    at = np.searchsorted(key, np.arange(slices + 1) * (2 * p.cells))
    some = np.flatnonzero(np.diff(at))
    once_, twice_ = [], []
    for s in some:
        cells, hot = (key[at[s] : at[s + 1]] - s * 2 * p.cells).astype(np.uint32), many[at[s] : at[s + 1]]
        once_.append(cells[~hot].tobytes())
        twice_.append(cells[hot].tobytes())
    return pa.table({"slice": pa.array(some, pa.int32()), "block": pa.array(np.full(len(some), block), pa.int32()), "once": pa.array(once_, pa.binary()), "twice": pa.array(twice_, pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """One slice of all blocks: to each block its cells that are counted twice or more."""
    blocks = table.column("block").to_numpy()
    once = [np.frombuffer(x, np.uint32) for x in table.column("once").to_pylist()]
    twice = [np.frombuffer(x, np.uint32) for x in table.column("twice").to_pylist()]
    every = np.sort(np.concatenate(once + twice + twice))
    hot = np.unique(every[1:][every[1:] == every[:-1]])
    out_block, out_cells = [], []
    for b, o, t in zip(blocks, once, twice):
        mine = np.union1d(o[np.isin(o, hot, assume_unique=True)], t)
        if len(mine):
            out_block.append(int(b))
            out_cells.append(mine.astype(np.uint32).tobytes())
    s = table.column("slice")[0].as_py()
    return pa.table({"__block": pa.array(out_block, pa.int32()), "slice": pa.array([s] * len(out_block), pa.int32()), "cells": pa.array(out_cells, pa.binary())})


def _first_of_equals(h1: np.ndarray, h2: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each window the index of the first equal one, by rank of the id, then place."""
    n = len(h1)
    if not n:
        return np.zeros(0, np.int64)
    if (np.diff(ranks) < 0).any() or ((np.diff(places) < 0) & (np.diff(ranks) == 0)).any():
        turn = np.lexsort((places, ranks))
        out = np.empty(n, np.int64)
        out[turn] = turn[_first_of_equals(h1[turn], h2[turn], ranks[turn], places[turn])]
        return out
    by = np.argsort(h1)
    start = np.flatnonzero(np.r_[True, h1[by][1:] != h1[by][:-1]])
    first = np.minimum.reduceat(by, start)
    out = np.empty(n, np.int64)
    out[by] = np.repeat(first, np.diff(np.r_[start, n]))
    if (h2 != h2[out]).any():  # two windows with one half of the digest: the other half decides
        by = np.lexsort((h2, h1))
        start = np.flatnonzero(np.r_[True, (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])])
        out[by] = np.repeat(np.minimum.reduceat(by, start), np.diff(np.r_[start, n]))
    return out


def _candidates(table: pa.Table, hot: pa.Table, slices: int, p: Params) -> pa.Table:
    """The block's distinct windows that are estimated repeated, each with its first place here."""
    w = Windows(table, p) if table.num_rows and hot.num_rows else None
    if w is None or not len(w.start):
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())], names=["h1", "h2", "__block", "doc_id", "at"])
    anchors, places = w.anchors()
    keys = np.concatenate([np.frombuffer(c, np.uint32).astype(np.int64) + s * (2 * p.cells) for s, c in zip(hot.column("slice").to_pylist(), hot.column("cells").to_pylist())])
    keys.sort()
    # windows side by side mostly share their anchor's place
    run = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    good = np.ones(len(run), bool)
    for s, c in _cells(anchors[run], slices, p):
        key = s * (2 * p.cells) + c
        good &= keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
    chosen = np.flatnonzero(np.repeat(good, np.diff(np.r_[run, len(anchors)])))
    h1, h2 = (h[chosen] for h in w.digests())
    ranks, at = (x[chosen] for x in w.places())
    first = np.flatnonzero(_first_of_equals(h1, h2, ranks, at) == np.arange(len(chosen)))
    text = w.text_of_window()[chosen[first]]
    block = table.column("__block")[0].as_py()
    return pa.table({
        "h1": pa.array(h1[first].view(np.int64)), "h2": pa.array(h2[first].view(np.int32)), "__block": pa.array(np.full(len(first), block, np.int32)),
        "doc_id": pa.array([w.ids[t] for t in text.tolist()], pa.int64()), "at": pa.array(at[first].astype(np.int32)),
    })


def _kept(table: pa.Table, elsewhere: pa.Table, p: Params, with_text: bool) -> pa.Table:
    """Removes each window that starts earlier in the block, or elsewhere."""
    w = Windows(table, p)
    n = len(w)
    again = np.zeros(len(w.start), bool)
    if len(w.start):
        h1, h2 = w.digests()
        ranks, places = w.places()
        first = _first_of_equals(h1, h2, ranks, places)
        again = (ranks != ranks[first]) | (places != places[first])
        if elsewhere.num_rows:
            e1, e2 = elsewhere.column("h1").to_numpy().view(np.uint64), elsewhere.column("h2").to_numpy().view(np.uint32)
            order = np.argsort(e1, kind="stable")
            e1, e2 = e1[order], e2[order]
            lo = np.searchsorted(e1, h1, "left")
            some = np.flatnonzero((lo < len(e1)) & (e1[np.minimum(lo, len(e1) - 1)] == h1))
            lo, hi = lo[some], np.searchsorted(e1, h1[some], "right")
            for d in range(int((hi - lo).max()) if len(some) else 0):
                again[some] |= (lo + d < hi) & (e2[np.minimum(lo + d, len(e1) - 1)] == h2[some])
    gone = tk.covered(n, w.start[again], p.length) if n else np.zeros(0, bool)
    counts = np.diff(w.first)
    removed = tk.per_text_sum(gone, w.first)
    raw, first = w.buf.tobytes(), w.first
    texts, sha = [], []
    for k in range(len(w.ids)):
        keep = first[k] + np.flatnonzero(~gone[first[k] : first[k + 1]])
        text = b" ".join([raw[x:y] for x, y in zip(w.word_start[keep].tolist(), w.word_end[keep].tolist())])
        sha.append(hashlib.sha256(text).hexdigest())
        if with_text:
            texts.append(text.decode("utf-8", "replace"))
    out = {"doc_id": pa.array(w.ids, pa.int64()), "n_words": pa.array(counts), "n_removed": pa.array(removed), "kept_sha256": pa.array(sha, pa.string())}
    return pa.table(out | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))


def deduplicate(docs: DataFrame, params: Params | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (with_text: and kept_text) of each document."""
    p = params or Params()
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    total = text_bytes(docs)
    slices = max(1, -(-total // p.slice_bytes))
    blocks, _ = in_blocks(docs, ["doc_id", "text"], total, p.block_bytes)
    by_block = lambda df: df.groupBy("__block")

    sketch = by_block(blocks).applyInArrow(lambda t: _sketch(t, slices, p), "slice int, block int, once binary, twice binary")
    hot = sketch.groupBy("slice").applyInArrow(_merge, "__block int, slice int, cells binary")
    schema = "h1 long, h2 int, __block int, doc_id long, at int"
    candidates = by_block(blocks).cogroup(by_block(hot)).applyInArrow(lambda a, b: _candidates(a, b, slices, p), schema)
    place = F.struct("doc_id", "at")
    first = F.min(place).over(Window.partitionBy("h1", "h2"))
    elsewhere = candidates.withColumn("__first", first).where(~place.eqNullSafe(F.col("__first"))).select("__block", "h1", "h2")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def last(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())} | ({"kept_text": pa.array([], pa.string())} if with_text else {}))
        return _kept(a, b, p, with_text)

    return by_block(blocks).cogroup(by_block(elsewhere)).applyInArrow(last, schema)
