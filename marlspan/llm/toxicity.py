"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a text: densities of lexicon words (learned whole words and word beginnings, and a
short general list), how near lexicon words stand to second-person words, shares of capitals,
punctuation, digits and symbols, rates of obfuscated spellings, and lengths.

Learning uses a bounded sample of the labelled rows outside the held-out fold
(`max_train` rows, the first by hash of the id), in three parts: the lexicon comes from the first,
the trees from the second, the calibration from the third.  Scoring covers all rows.
A score is the calibrated probability, read off between the knots of the isotonic steps by straight lines, with
2 % of the trees' own probability mixed in, so that texts on one step keep their order.

Defined results.  Null is the empty text and scores what its features give.  Rows without a
label are scored alike.  Without labels of both classes every score is the share of
label 1 (0 with none at all).  Repeated rows score alike, and what stands in other rows of a batch changes no
score; a doc_id with several labels counts with each.  An empty table gives no rows.  Very long texts are
measured whole.  Columns other than doc_id and text (labels: doc_id and toxic) are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .cluster import cut, fold_of, fold_of_value, small_batches


@dataclass(frozen=True)
class Params:
    """max_train: labelled rows used at most; support, log_odds: what a lexicon term needs."""

    max_train: int = 30_000
    support: int = 4
    log_odds: float = 2.5
    prefixes: tuple[int, ...] = (4, 5, 6)
    near: int = 5
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    threshold: float = 0.7


#: General insults, and second-person words of the corpus's languages.
GENERAL = "idiot stupid moron loser trash scum worthless pathetic disgusting clown dumb imbecile freak filth crap shut hate kill".split()
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer sie ihnen usted ustedes vosotros tú ti contigo".split()

FEATURES = (
    "whole_density", "prefix_density", "general_density", "weight_per_word", "weight_max", "hits", "near_second", "second_density",
    "capitals", "shouted", "bangs", "punctuation", "digits", "symbols", "obfuscated", "repeated_chars", "log_words", "word_length",
)

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_ALPHA = _UPPER | ((_B >= 97) & (_B <= 122)) | (_B >= 128)
_DIGIT = (_B >= 48) & (_B <= 57)
_PUNCT = np.isin(_B, np.frombuffer(b".,;:!?", np.uint8))
_SYMBOL = np.isin(_B, np.frombuffer(b"#*$%&|<>@~^_=+", np.uint8))
_APART = tk.NON_ALNUM


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tk.span_hash(tk.byte_sums(raw), np.array([0]), np.array([len(raw)]))[0])


class Lexicon:
    """Learned terms: hashes of whole words (length 0) and of word beginnings (their bytes), with weights."""

    def __init__(self, terms: list[tuple[int, int, float]]):
        self.tables = {}
        for length in sorted({t[0] for t in terms}):
            own = sorted((h & (1 << 64) - 1, w) for n, h, w in terms if n == length)
            self.tables[length] = np.array([h for h, _ in own], np.uint64), np.array([w for _, w in own])
        self.general = np.sort(np.array([_hash_of(w) for w in GENERAL], np.uint64))
        self.second = np.sort(np.array([_hash_of(w) for w in SECOND], np.uint64))


def _member(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index in the sorted table, or -1."""
    if not len(table) or not len(h):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _prefix_hash(w: tk.Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the words longer than that many bytes."""
    long = np.flatnonzero(w.end - w.start > length)
    return long, tk.span_hash(w.sums, w.start[long], w.start[long] + length)


def features(buf: np.ndarray, off: np.ndarray, lexicon: Lexicon, near: int) -> np.ndarray:
    """(texts, features)."""
    texts = len(off) - 1
    w = tk.Words(tk.LOWER[buf], off, _APART)
    n = w.per_text()
    words = np.maximum(n, 1)
    chars = np.maximum(np.diff(off), 1)
    per = lambda flag: tk.per_text_sum(flag, w.first)
    count = lambda table: tk.per_text_sum(table[buf], off)
    whole = np.zeros(len(w))
    at = _member(lexicon.tables.get(0, (np.zeros(0, np.uint64), np.zeros(0)))[0], w.hash)
    if (at >= 0).any():
        whole[at >= 0] = lexicon.tables[0][1][at[at >= 0]]
    prefix = np.zeros(len(w))
    for length, (table, weight) in lexicon.tables.items():
        if length:
            some, h = _prefix_hash(w, length)
            at = _member(table, h)
            good = at >= 0
            prefix[some[good]] = np.maximum(prefix[some[good]], weight[at[good]])
    general = _member(lexicon.general, w.hash) >= 0
    second = _member(lexicon.second, w.hash) >= 0
    weight = np.maximum(whole, prefix)
    hit = (weight > 0) | general
    text = w.text_of()
    close = np.zeros(len(w), bool)
    for d in range(1, near + 1):
        same = text[d:] == text[:-d]
        close[d:] |= hit[d:] & second[:-d] & same
        close[:-d] |= hit[:-d] & second[d:] & same
    most = np.zeros(texts)
    np.maximum.at(most, text, weight)
    upper = tk.per_text_sum(_UPPER[buf], off)
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(_UPPER[buf], out=sums[1:])
    shouted = (sums[w.end] - sums[w.start] == w.end - w.start) & (w.end - w.start > 2)
    np.cumsum(_DIGIT[buf], out=sums[1:])
    digits = sums[w.end] - sums[w.start]
    size = w.end - w.start
    mixed = (digits > 0) & (digits < size) & (size < 20)
    # a sign between two letters, and three equal letters
    inner = np.zeros(len(buf), bool)
    triple = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = _ALPHA[buf[:-2]] & _SYMBOL[buf[1:-1]] & _ALPHA[buf[2:]]
        triple[2:] = _ALPHA[buf[2:]] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
        # none of them across the end of a text
        begin = off[off < len(buf)]
        inner[begin] = triple[begin] = False
        inner[begin[begin > 0] - 1] = triple[begin[begin < len(buf) - 1] + 1] = False
    obfuscated = per(mixed) + tk.per_text_sum(inner, off)
    letters = np.maximum(count(_ALPHA), 1)
    out = [
        per(whole > 0) / words, per(prefix > 0) / words, per(general) / words, per(weight) / words, most, np.log1p(per(hit)), per(close) / words, per(second) / words,
        upper / letters, per(shouted) / words, tk.per_text_sum(buf == 33, off) / words, count(_PUNCT) / words, count(_DIGIT) / chars, count(_SYMBOL) / words,
        obfuscated / words, tk.per_text_sum(triple, off) / words, np.log1p(n), per(size) / words,
    ]
    return np.stack(out, 1) if texts else np.zeros((0, len(FEATURES)))


# ---- learning ----


@dataclass
class Tree:
    """Complete binary tree: feature, cut and value by node; a node without a split has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (x[rows, f] > self.cut[node]), node)
        return self.value[node]


def boost(x: np.ndarray, y: np.ndarray, p: Params) -> tuple[float, list[Tree]]:
    """Log-loss boosting with second-order gains over quantile bins."""
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, p.bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, trees, nodes = np.full(len(y), base), [], 2 ** (p.depth + 1) - 1
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        tree = Tree(np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes))
        node = np.zeros(len(y), np.int64)
        for at in range(nodes):
            rows = np.flatnonzero(node == at)
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.value[at] = -p.rate * gs / (hs + 1.0)
            if at >= nodes // 2 or len(rows) < 20:
                continue
            best = (1e-4, -1, 0)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < 5) | (len(rows) - nl < 5)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
            if best[1] >= 0:
                tree.feature[at], tree.cut[at] = best[1], cuts[best[1]][best[2]]
                node[rows] = 2 * at + 1 + (x[rows, best[1]] > tree.cut[at])
        score = score + tree(x)
        trees.append(tree)
    return base, trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: score knots and their probabilities, smoothed by one count at each end."""
    by = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of scores
    for s, t in zip(score[by].tolist(), y[by].tolist()):
        blocks.append([t, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[1] for b in blocks])
    return knots, np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])


@dataclass
class Model:
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    knots: np.ndarray
    probability: np.ndarray
    near: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t(x)
        return out

    def score(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Calibrated probability, with a trace of the margin so that equal steps keep an order."""
        if not self.trees:
            return np.full(len(off) - 1, self.base)
        margin = self.margin(features(buf, off, self.lexicon, self.near))
        step = np.interp(margin, self.knots, self.probability)
        return np.clip(0.98 * step + 0.02 / (1 + np.exp(-margin)), 0.0, 1.0)


def sample_of(labels: DataFrame, p: Params) -> DataFrame:
    """The labelled rows that learning uses: (doc_id, toxic, part), at most max_train."""
    rows = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(fold_of("doc_id", 3) != 1).withColumn("__h", F.xxhash64("doc_id"))
    rows = rows.orderBy("__h", "doc_id", "toxic").limit(p.max_train)
    return rows.select("doc_id", "toxic", F.pmod(F.col("__h"), F.lit(5)).cast("int").alias("part"))


def learn_lexicon(train: DataFrame, p: Params) -> Lexicon:
    """Terms that documents of label 1 hold far oftener than the others; their number is bounded as the sample is."""

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(0))
            y = b.column(1).to_numpy()
            for i, j in tk.chunks(off):
                w = tk.Words(tk.LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i], _APART)
                text = w.text_of()
                parts = [(0, w.hash, text)] + [(n, h, text[some]) for n in p.prefixes for some, h in [_prefix_hash(w, n)]]
                for n, h, t in parts:
                    by = np.lexsort((t, h))
                    h, t = h[by], t[by]
                    new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])] if len(h) else np.zeros(0, bool)
                    h, label = h[new], y[i:j][t[new]]
                    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                    ones = np.add.reduceat(label, first) if len(first) else np.zeros(0)
                    total = np.diff(np.r_[first, len(h)])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), n, np.int32)), pa.array(h[first].view(np.int64)), pa.array(ones.astype(np.int64)), pa.array((total - ones).astype(np.int64))], ["length", "term", "ones", "others"])

    sizes = {r.toxic: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms = train.select("text", "toxic").mapInArrow(run, "length int, term long, ones long, others long")
    terms = terms.groupBy("length", "term").agg(F.sum("ones").alias("ones"), F.sum("others").alias("others"))
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1.0)) - F.log((F.col("others") + 0.5) / (n0 + 1.0))
    best = terms.where(F.col("ones") >= p.support).withColumn("odds", odds).where(F.col("odds") >= p.log_odds)
    return Lexicon([(r["length"], r["term"], r["odds"]) for r in best.collect()])


def _one_text_each(train: DataFrame) -> DataFrame:
    """Where rows share a sampled id, the least of their texts alone: so the sample bounds what is learned from, whatever repeats."""
    counts = train.groupBy("doc_id", "toxic", "part").agg(F.count("*").alias("__n"))
    shared = cut(counts.where("__n > 1").drop("__n"))
    if shared.isEmpty():
        return train
    one = train.join(F.broadcast(shared), ["doc_id", "toxic", "part"]).groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text"))
    return cut(train.join(F.broadcast(shared), ["doc_id", "toxic", "part"], "left_anti").unionByName(one))


def learn(docs: DataFrame, labels: DataFrame, p: Params) -> Model:
    spark = docs.sparkSession
    sample = sample_of(labels, p)
    train = _one_text_each(cut(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")))
    sizes = {(r.toxic, r["part"] < 2): r["n"] for r in train.groupBy("toxic", "part").agg(F.count("*").alias("n")).collect()}
    ones = sum(n for (t, _), n in sizes.items() if t == 1)
    total = sum(sizes.values())
    if not ones or ones == total:
        return Model(Lexicon([]), ones / total if total else 0.0, [], np.zeros(0), np.zeros(0), p.near)
    lexicon = learn_lexicon(train.where("part < 2"), p)
    shared = spark.sparkContext.broadcast(lexicon)
    near = p.near

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(0))
            x = [features(buf[off[i] : off[j]], off[i : j + 1] - off[i], shared.value, near) for i, j in tk.chunks(off)]
            x = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), b.column(1), b.column(2)], ["x", "toxic", "part"])

    rows = train.where("part >= 2").select("text", "toxic", "part").mapInArrow(run, "x array<double>, toxic int, part int").orderBy("x", "toxic", "part").collect()
    x, y, part = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.toxic for r in rows], float), np.array([r["part"] for r in rows])
    fit, rest = part < 4, part == 4
    if not 0 < y[fit].sum() < fit.sum():
        fit = rest = np.ones(len(y), bool)
    base, trees = boost(x[fit], y[fit], p)
    model = Model(lexicon, base, trees, np.zeros(0), np.zeros(0), p.near)
    if not 0 < y[rest].sum() < rest.sum():
        rest = fit
    model.knots, model.probability = isotonic(model.margin(x[rest]), y[rest])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    p = params or Params()
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, p))

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            scores = [model.value.score(buf[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in tk.chunks(off)]
            score = np.concatenate(scores) if scores else np.zeros(0)
            held = [fold_of_value(i, 3) == 1 for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= p.threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
