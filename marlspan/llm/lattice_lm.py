"""Language-model scores: the marginal of all subword segmentations.

The pieces are those of a public tokenizer's vocabulary, which is left as it is.  Its scores fall
by one from piece to piece (it lists them by merge rank), so they are read as Zipf
ranks: the first weights are 1 / (rank + 2.7), made to sum to one.  The training fold then
re-estimates the weights of the pieces by expected counts over all segmentations (forward and
backward in log space), smoothed by the first weights.  A word's probability is the sum
over all its segmentations; words are cut at white space, which no piece crosses, so a
text's marginal is the product of its words' and of the end's.  A character that is no piece
is spelled in byte pieces.

Counts cover the whole training fold.  Each distinct word goes through the lattice once, however
often it occurs; documents are dealt into blocks, each block names its distinct words and is
told their counts and log probabilities, and scores its texts with those.

Defined results.  Null and empty texts are one end token.  A null doc_id has the fold of the
empty id.  An empty training fold: N = V = 0, the first weights, P(end) = 1/2.  Repeated
rows count as often as they occur.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut, fold_of, fold_of_value, in_blocks, small_batches, text_bytes


@dataclass(frozen=True)
class Params:
    """keep_words: distinct words that a task of the first pass holds before it passes them on; together: words whose lattices are made at once."""

    modulus: int = 7
    held_out: int = 2
    rounds: int = 2
    smoothing: float = 500.0
    block_bytes: int = 12 << 20
    keep_words: int = 400_000
    together: int = 65_536


SPACE_MARK = "▁"
#: What no piece begins with.
NO_HEAD = 1.0


@dataclass
class Pieces:
    """weight: piece -> log weight; table: that, and None for the beginnings of pieces; bytes: log weights of the byte pieces."""

    weight: dict[str, float]
    table: dict[str, float | None]
    bytes: list[float]
    names: list[str]

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = [max(0.0, -model.get_score(model.piece_to_id(n))) for n in names]
        rank = [r if r < 1e8 else float(len(names)) for r in rank]
        # byte pieces come first in the file but are the last resort
        mass = [1 / ((len(names) if len(n) == 6 and n.startswith("<0x") else r) + 2.7) for n, r in zip(names, rank)]
        return cls.of(names, [m / math.fsum(mass) for m in mass])

    @classmethod
    def of(cls, names: list[str], mass: list[float]) -> Pieces:
        log = dict(zip(names, (math.log(m) for m in mass)))
        single = [log.pop(f"<0x{b:02X}>") for b in range(256)]
        heads = dict.fromkeys(n[:k] for n in log for k in range(1, len(n)))
        return cls(log, heads | log, single, names)

    def spelled(self, char: str) -> float:
        return math.fsum(self.bytes[b] for b in char.encode())

    def log_probability(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word, its space mark included."""
        s, get = SPACE_MARK + word, self.table.get
        n = len(s)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        terms[0].append(0.0)
        for i in range(n):
            a = _log_sum(terms[i])
            for j in range(i + 1, n + 1):
                w = get(s[i:j], NO_HEAD)
                if w is None:
                    continue
                if w is NO_HEAD:
                    break
                terms[j].append(a + w)
            if s[i] not in self.weight:
                terms[i + 1].append(a + self.spelled(s[i]))
        return _log_sum(terms[n])

    def expect(self, word: str, times: int, into: dict[str, float]) -> None:
        """Adds the expected number of each piece: forward, then backward."""
        s, get = SPACE_MARK + word, self.table.get
        n = len(s)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        terms[0].append(0.0)
        alpha, arcs = [], []
        for i in range(n):
            a = _log_sum(terms[i])
            alpha.append(a)
            here = []
            for j in range(i + 1, n + 1):
                piece = s[i:j]
                w = get(piece, NO_HEAD)
                if w is None:
                    continue
                if w is NO_HEAD:
                    break
                terms[j].append(a + w)
                here.append((j, w, piece))
            if s[i] not in self.weight:
                w = self.spelled(s[i])
                terms[i + 1].append(a + w)
                here.append((i + 1, w, None))
            arcs.append(here)
        whole = _log_sum(terms[n])
        beta = [-math.inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            rest = [w + beta[j] for j, w, _ in arcs[i]]
            beta[i] = _log_sum(rest)
            base = alpha[i] - whole
            for t, (_, _, piece) in zip(rest, arcs[i]):
                p = times * math.exp(base + t)
                if piece is not None:
                    into[piece] = into.get(piece, 0.0) + p
                else:
                    for b in s[i].encode():
                        name = f"<0x{b:02X}>"
                        into[name] = into.get(name, 0.0) + p


class Lattices:
    """The lattices of many words at once: words of one length are rows of a table, and the recursions run along its columns.

    The pieces form a trie; one step of all walks is one lookup in an open hash table of (node, character).
    """

    #: Longer words, and those fewer than characters, go one by one; cells of a table at most.
    LONG, CELLS = 48, 1 << 15

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        order = sorted(pieces.table, key=len)
        node = {"": 0} | {s: k for k, s in enumerate(order, 1)}
        chars = sorted({s[-1] for s in order})
        self.code = np.zeros(0x110000, np.int64)
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.step = len(chars) + 1
        self.longest = max(map(len, order))
        self.weight = np.array([-np.inf] + [-np.inf if pieces.table[s] is None else pieces.table[s] for s in order])
        self.name = ["", *order]
        size = 1 << (4 * len(order)).bit_length()
        self.mask, self.keys, self.child = size - 1, np.full(size, -1, np.int64), np.zeros(size, np.int64)
        keys = np.array([node[s[:-1]] * self.step + self.code[ord(s[-1])] for s in order])
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # one of those that meet stays
            done = self.keys[at[left]] == keys[left]
            self.child[at[left[done]]] = left[done] + 1
            left = left[~done]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def _go(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The child of each node by each character, 0 where there is none."""
        keys = node * self.step + code
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.child[at], 0)
        more = np.flatnonzero((found != keys) & (found >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            found = self.keys[at[more]]
            hit = found == keys[more]
            out[more[hit]] = self.child[at[more[hit]]]
            more = more[~hit & (found >= 0)]
        return out

    def _arcs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w, node, spelled) of words as rows of code points: by length less one, the log weight and node of the piece from each place; the places of spelled characters."""
        m, n = points.shape
        code = self.code[points].ravel()
        w = np.full((min(n, self.longest), m * n), -np.inf)
        nodes = np.zeros(w.shape, np.int64)
        place = np.flatnonzero(code)
        node = np.zeros(len(place), np.int64)
        for k in range(len(w)):
            node = self._go(node, code[place + k])
            on = node > 0
            place, node = place[on], node[on]
            w[k, place], nodes[k, place] = self.weight[node], node
            on = place % n + k + 1 < n
            place, node = place[on], node[on]
        spelled = np.flatnonzero(w[0] == -np.inf)
        if len(spelled):
            chars, which = np.unique(points.ravel()[spelled], return_inverse=True)
            w[0, spelled] = np.array([self.pieces.spelled(chr(c)) for c in chars.tolist()])[which]
        return w.reshape(len(w), m, n), nodes.reshape(len(w), m, n), spelled

    @staticmethod
    def _forward(w: np.ndarray) -> np.ndarray:
        longest, m, n = w.shape
        alpha = np.full((n + 1, m), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            alpha[j] = _log_sums(np.stack([alpha[j - k - 1] + w[k, :, j - k - 1] for k in range(min(j, longest))]))
        return alpha

    def _tables(self, words: list[str]):
        """(rows, points) for words of one length; rows alone where they go one by one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        bounds = np.flatnonzero(np.diff(lengths[order])) + 1
        for rows in np.split(order, bounds):
            n = int(lengths[rows[0]]) + 1 if len(rows) else 0
            if len(rows) < n or n > self.LONG:
                yield rows, None
                continue
            for k in range(0, len(rows), max(1, self.CELLS // n)):
                part = rows[k : k + max(1, self.CELLS // n)]
                text = "".join([SPACE_MARK + words[i] for i in part.tolist()])
                yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(part), n)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural log of the sum over all segmentations of each word."""
        out = np.zeros(len(words))
        for rows, points in self._tables(words):
            if points is None:
                out[rows] = [self.pieces.log_probability(words[i]) for i in rows.tolist()]
            else:
                out[rows] = self._forward(self._arcs(points)[0])[-1]
        return out

    def expect(self, words: list[str], times: np.ndarray, into: dict[str, float]) -> None:
        """Adds the expected number of each piece over all words."""
        total = np.zeros(len(self.name))
        for rows, points in self._tables(words):
            if points is None:
                for i in rows.tolist():
                    self.pieces.expect(words[i], int(times[i]), into)
                continue
            w, nodes, spelled = self._arcs(points)
            longest, m, n = w.shape
            alpha = self._forward(w)
            beta = np.full((n + 1, m), -np.inf)
            beta[n] = 0.0
            here = times[rows].astype(np.float64)
            in_bytes = np.zeros(m * n, bool)
            in_bytes[spelled] = True
            in_bytes = in_bytes.reshape(m, n)
            for i in range(n - 1, -1, -1):
                rest = np.stack([w[k, :, i] + beta[i + k + 1] for k in range(min(longest, n - i))])
                beta[i] = _log_sums(rest)
                p = here * np.exp(rest + (alpha[i] - alpha[n]))
                odd = np.flatnonzero(in_bytes[:, i])
                for r in odd.tolist():
                    for b in chr(int(points[r, i])).encode():
                        name = f"<0x{b:02X}>"
                        into[name] = into.get(name, 0.0) + float(p[0, r])
                p[0, odd] = 0.0
                total += np.bincount(nodes[: len(p), :, i].ravel(), p.ravel(), len(total))
        for k in np.flatnonzero(total).tolist():
            if k:
                into[self.name[k]] = into.get(self.name[k], 0.0) + float(total[k])


def _log_sums(terms: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials down the rows; each column has a finite term."""
    if len(terms) == 1:
        return terms[0]
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def gathered(batches, rows: int, most_bytes: int = 16 << 20):
    """The batches, joined up to about so many rows or bytes."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n, size = n + b.num_rows, size + b.nbytes
        if n >= rows or size >= most_bytes:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    if len(terms) == 2:
        a, b = terms
        return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))
    top = max(terms)
    return top + log(sum([exp(t - top) for t in terms]))


def _words(text: str | None) -> list[bytes]:
    # bytes.lower() and bytes.split() know ASCII alone, as the token pattern does
    return (text or "").encode().lower().split()


def count_words(docs: DataFrame, p: Params) -> DataFrame:
    """(word, n): every distinct word of all texts, with its number in the training fold."""

    def run(batches):
        train, other = Counter(), set()

        def rows():
            words = list(train) + [w for w in other if w not in train]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([train.get(w, 0) for w in words], pa.int64())], ["word", "n"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if fold_of_value(i, p.modulus) == p.held_out:
                    other.update(_words(t))
                else:
                    train.update(_words(t))
            if len(train) + len(other) > p.keep_words:
                yield rows()
                train.clear()
                other.clear()
        yield rows()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(vocabulary: DataFrame, path: str, p: Params) -> Pieces:
    """The pieces, their weights re-estimated from the vocabulary's counts; at most one row per piece is fetched."""
    first = Pieces.read(path)
    pieces = first
    for _ in range(p.rounds):
        shared = vocabulary.sparkSession.sparkContext.broadcast(pieces)

        def run(batches, shared=shared):
            into: dict[str, float] = {}
            lattices = Lattices(shared.value)
            for b in gathered(batches, p.together):
                lattices.expect(b.column(0).to_pylist(), b.column(1).to_numpy(), into)
            yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.string()), pa.array(list(into.values()), pa.float64())], ["piece", "e"])

        rows = vocabulary.where("n > 0").mapInArrow(run, "piece string, e double").groupBy("piece").agg(F.sum("e").alias("e")).collect()
        expected = {r.piece: r.e for r in rows}
        total = math.fsum(expected.values()) + p.smoothing
        prior = {n: first.weight.get(n) if n in first.weight else first.bytes[int(n[1:-1], 16)] for n in first.names}
        pieces = Pieces.of(first.names, [(expected.get(n, 0.0) + p.smoothing * math.exp(prior[n])) / total for n in first.names])
    return pieces


def score_documents(docs: DataFrame, pieces_path: str, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each document."""
    p = params or Params()
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    vocabulary = cut(count_words(docs, p))
    ends = docs.where(fold_of("doc_id", p.modulus) != p.held_out).count()
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    tokens, kinds = n + ends, v + (ends > 0)
    pieces = learn(vocabulary, pieces_path, p)
    shared = spark.sparkContext.broadcast(pieces)
    # each word is one draw of "goes on" and each text one of "ends"
    end, on = math.log10((ends + 1) / (tokens + 2)), math.log10((n + 1) / (tokens + 2))

    def marginal(batches):
        lattices = Lattices(shared.value)
        for b in gathered(batches, p.together):
            log = lattices.log_probabilities(b.column(0).to_pylist()) / math.log(10) + on
            yield from pa.table([b.column(0), b.column(1), pa.array(log)], ["word", "n", "log10"]).to_batches()

    scored = vocabulary.mapInArrow(marginal, "word string, n long, log10 double")
    blocks, _ = in_blocks(docs, ["doc_id", "text"], text_bytes(docs), p.block_bytes)

    def distinct(t: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for text in t.column("text").to_pylist():
            words.update(_words(text))
        return pa.table({"word": pa.array(list(words), pa.binary()).cast(pa.string()), "__block": pa.array([t.column("__block")[0].as_py()] * len(words), pa.int32())})

    told = blocks.groupBy("__block").applyInArrow(distinct, "word string, __block int").join(scored, "word").select("__block", "word", "n", "log10")
    space, base_end = math.log10(tokens + kinds + 1), math.log10(ends + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        at = {w: k for k, w in enumerate(right.column("word").cast(pa.binary()).to_pylist())}
        count = right.column("n").to_numpy()
        base, log, known = np.log10(count + 1.0), right.column("log10").to_numpy(), count > 0
        ids, out = left.column("doc_id").to_pylist(), []
        for i, text in zip(ids, left.column("text").to_pylist()):
            words = _words(text)
            k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            out.append((len(words) + 1, int(known[k].sum()) + (ends > 0), float(base[k].sum()) + base_end - space * (len(words) + 1), float(log[k].sum()) + end))
        n_tokens, n_known, base_score, lattice = zip(*out) if out else ((), (), (), ())
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([fold_of_value(i, p.modulus) == p.held_out for i in ids], pa.bool_()),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([tokens] * len(ids), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(lattice, pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("__block").cogroup(told.groupBy("__block")).applyInArrow(score, schema)
