"""Byte-level BPE as a lazily determinised finite-state transducer.

The ranks are compiled, on demand, into a nondeterministic transducer over bytes: a
state is the token emitted last and a node of the byte trie of the vocabulary.  It
may emit the node's token only where that token may stand after the last one,
i.e. where merging the two tokens' bytes gives back just these two; a token sequence
whose neighbours all agree in that way is the one that merging by rank
gives.  Determinising keeps the set of states with what each still has to emit and
emits the common part as soon as all agree: the lookahead is bounded by how far the
hypotheses differ.  Sets of states and their moves are made when a text first
needs them, numbered, and kept.

Decoding is a transducer of its own: its state is the bytes of an unfinished UTF-8
character, its moves are made per token when first needed, and it yields text
as soon as characters are whole.

Defined results.  Null is the empty text: no tokens, empty text back.  Repeated rows give equal rows, an
empty table none; very long texts are encoded whole, one at a time; columns other than doc_id and text are not read,
whatever their names.  A piece that is itself a token is that token.  Bytes that are no UTF-8 decode to
U+FFFD, one for each maximal bad part.  Vocabulary files are read from their path,
on the driver, once.
"""

from __future__ import annotations

import base64
import gc
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .cluster import small_batches

#: Bytes of text that are encoded at a time (a longer single text goes alone).
PASS_BYTES = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Merges:
    """Which tokens may be neighbours.

    Merging by rank makes a token step by step, and with it the parts at its two ends
    grow.  Two tokens may be neighbours if at no time the last part of the left one
    and the first part of the right one would be merged before they grow further.
    """

    #: Kept answers beyond which they are forgotten.
    MOST = 500_000
    NEVER = 1 << 60

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.agreed: dict[int, bool] = {}
        self._grown: dict[int, tuple[bool, list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}

    def grown(self, token: int) -> tuple[bool, list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """Whether merging makes the token; the parts at its left and its right end, each with the rank that ends it."""
        known = self._grown.get(token)
        if known is None:
            raw = self.tokens[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            ends: tuple[list, list] = ([], [])
            latest = -1
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], self.NEVER), i) for i in range(len(parts) - 1))
                if best == self.NEVER:
                    break
                latest = max(latest, best)
                if at == 0:
                    ends[0].append((parts[0], latest))
                if at == len(parts) - 2:
                    ends[1].append((parts[-1], latest))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ends[0].append((parts[0], self.NEVER))
            ends[1].append((parts[-1], self.NEVER))
            known = self._grown[token] = (len(parts) == 1, *ends)
        return known

    def whole(self, token: int) -> bool:
        """Whether merging makes the token of its bytes; others are never emitted within a piece."""
        return self.grown(token)[0]

    def agree(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.agreed.get(key)
        if known is None:
            if len(self.agreed) > self.MOST:
                self.agreed.clear()
            known = self.agreed[key] = self._stay_apart(self.grown(left)[2], self.grown(right)[1])
        return known

    def _stay_apart(self, left: list[tuple[bytes, int]], right: list[tuple[bytes, int]]) -> bool:
        get, i, j = self.ranks.get, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = get(x + y, self.NEVER)
            if across < x_ends and across <= y_ends and across != self.NEVER:
                return False
            if x_ends == y_ends == self.NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


#: A deterministic state: ((last token, trie node, tokens not yet emitted), ...); -1: no token yet.
State = tuple[tuple[int, int, tuple[int, ...]], ...]


class Transducer:
    """Encodes one piece, byte by byte."""

    #: Kept states and moves beyond which both are forgotten and made anew.
    MOST = 300_000
    UNTOLD = -2

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                to = self.child.get(key)
                if to is None:
                    to = self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = rank
        self.emits = [self.UNTOLD] * len(self.token_at)
        # nodes that a hypothesis can go on from
        self.inner = [False] * len(self.token_at)
        for key in self.child:
            self.inner[key >> 8] = True
        self._forget()

    def _forget(self) -> None:
        start: State = ((-1, 0, ()),)
        self.states: list[State] = [start]
        self.number: dict[State, int] = {start: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def _emits(self, node: int) -> int:
        """The node's token if merging makes it, else -1; told once per node."""
        token = self.token_at[node]
        if token >= 0 and not self.merges.whole(token):
            token = -1
        self.emits[node] = token
        return token

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        after: dict[tuple[int, int], tuple[int, ...]] = {}
        child, emits, inner, agreed = self.child.get, self.emits, self.inner, self.merges.agreed.get
        for last, node, owed in self.states[state]:
            to = child(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                after[last, to] = owed
            token = emits[to]
            if token == self.UNTOLD:
                token = self._emits(to)
            if token >= 0:
                good = last < 0 or agreed(last << 32 | token)
                if good or (good is None and self.merges.agree(last, token)):
                    after[token, 0] = (*owed, token)
        # what stands at the root must be able to go on, which any byte can; a state is told by all it owes
        owed_all = list(after.values())
        low = high = owed_all[0]
        if len(owed_all) > 1:
            low, high = min(owed_all), max(owed_all)
        if low and high and low[0] == high[0]:
            common = 1
            while common < len(low) and common < len(high) and low[common] == high[common]:
                common += 1
            emitted = low[:common]
            to_state: State = tuple([(last, node, owed[common:]) for (last, node), owed in after.items()])
        else:
            emitted, to_state = (), tuple([(last, node, owed) for (last, node), owed in after.items()])
        number = self.number.get(to_state)
        if number is None:
            number = self.number[to_state] = len(self.states)
            self.states.append(to_state)
        return number, emitted

    def _end(self, state: int) -> tuple[int, ...]:
        """What is owed at the end of the piece: of the one hypothesis that ends with a whole token."""
        (out,) = [owed for _, node, owed in self.states[state] if node == 0]
        return out

    def encode(self, piece: bytes) -> list[int]:
        if len(self.moves) > self.MOST:
            self._forget()
        out: list[int] = []
        state, moves = 0, self.moves
        for b in piece:
            key = state << 8 | b
            move = moves.get(key)
            if move is None:
                move = moves[key] = self._move(state, b)
            state = move[0]
            if move[1]:
                out.extend(move[1])
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._end(state)
        out.extend(end)
        return out


def white_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes are of characters with the White_Space property."""
    white = _ASCII_WHITE[buf]
    lead = np.flatnonzero(_WHITE_LEAD[buf])
    for head, width in _WHITE_WIDTH.items():
        at = lead[buf[lead] == head]
        at = at[at + width <= len(buf)]
        code = np.zeros(len(at), np.int64)
        for k in range(width):
            code = code << 8 | buf[at + k]
        for start in at[np.isin(code, _WHITE_CODES)].tolist():
            white[start : start + width] = True
    return white


#: The characters with the White_Space property.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_WHITE = np.isin(np.arange(256), [ord(c) for c in WHITE_SPACE if c < "\x80"])
_WIDE_WHITE = [c.encode() for c in WHITE_SPACE if c >= "\x80"]
_WHITE_WIDTH = {c[0]: len(c) for c in _WIDE_WHITE}
_WHITE_LEAD = np.isin(np.arange(256), list(_WHITE_WIDTH))
_WHITE_CODES = np.array([int.from_bytes(c, "big") for c in _WIDE_WHITE])


def _binary(buf: np.ndarray, off: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))])


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges starts[i]:starts[i] + lengths[i], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Encoder:
    """Texts to ids: the pattern cuts pieces, each goes through the transducer.

    No piece goes on past a space between two characters that are not white, and how the run
    from one such space to the next is cut depends on the run alone.  So the texts of a batch are
    cut there, in one pass over their bytes; the pattern cuts each distinct run, each distinct piece goes
    through the transducer, and the ids of all runs are gathered by number.
    """

    #: Pieces whose ids are kept in each of two generations, and the length in characters of one that is kept.
    MOST, LONG = 150_000, 64

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.transducer = ranks, Transducer(ranks)
        # the engines differ on \s for U+001C to U+001F; the tokenizer's has the White_Space property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def _ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of distinct pieces; the older answers go when the newer are many."""
        out = list(map(self.new.get, pieces))
        for k, known in enumerate(out):
            if known is None:
                piece = pieces[k]
                known = self.old.get(piece)
                if known is None:
                    raw = piece.encode()
                    rank = self.ranks.get(raw)
                    known = tuple(self.transducer.encode(raw)) if rank is None else (rank,)
                out[k] = known
                if len(piece) <= self.LONG:
                    self.new[piece] = known
        if len(self.new) > self.MOST:
            self.old, self.new = self.new, {}
        return out

    def _pieces(self, runs: pa.LargeBinaryArray) -> tuple[pa.Array, np.ndarray]:
        """(pieces, first): the pieces of the runs, and where those of each begin, with their number at the end."""
        n = len(runs)
        buf, off = tk.text_buffer(runs)
        white = white_bytes(buf)
        # runs of a space, another character and no white end can be cut side by side, as in a text
        plain = (np.diff(off) > 1) & (buf[off[:-1]] == 0x20) & ~white[np.minimum(off[:-1] + 1, len(buf) - 1)] & ~white[off[1:] - 1]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        size = np.diff(off)[order]
        n_plain = int(plain.sum())
        joined = buf[spread(off[:-1][order[:n_plain]], size[:n_plain])].tobytes().decode()
        found = self.pattern.findall(joined)
        if sum(map(len, found)) != len(joined):  # a pattern that leaves characters out: run by run
            found, n_plain = [], 0
        counts = []
        for raw in runs.take(pa.array(order[n_plain:])).to_pylist():
            here = self.pattern.findall(raw.decode())
            counts.append(len(here))
            found += here
        pieces = pa.array(found, pa.large_string())
        ends = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))
        side_by_side = np.searchsorted(ends, np.cumsum(size[:n_plain])) + 1
        last = np.concatenate([side_by_side, (side_by_side[-1] if n_plain else 0) + np.cumsum(np.array(counts, np.int64))])
        first = np.append(0, last)
        # back to the order of the runs
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        number = np.diff(first)[place]
        return pieces.take(pa.array(spread(first[:-1][place], number))), np.append(0, np.cumsum(number))

    def encode_all(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): the ids of all texts, and where those of each begin, with the total at the end."""
        white = white_bytes(buf)
        space = np.flatnonzero(buf == 0x20)
        space = space[(space > 0) & (space < len(buf) - 1)]
        space = space[~(white[space - 1] | white[space + 1])]
        begin = np.zeros(len(buf) + 1, bool)
        begin[off] = True
        # a space that ends a text is no cut: what comes after it is another text's
        space = space[~begin[space + 1]]
        begin[space] = True
        begin[len(buf)] = False
        start = np.flatnonzero(begin)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        runs = _binary(buf, np.append(start, len(buf))).dictionary_encode()
        pieces, first = self._pieces(runs.dictionary)
        pieces = pieces.dictionary_encode()
        parts = self._ids(pieces.dictionary.to_pylist())
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.uint32, int(lengths.sum()))
        # the ids of each distinct run, then of each run
        piece = pieces.indices.to_numpy(zero_copy_only=False)
        n = lengths[piece]
        flat = flat[spread((np.cumsum(lengths) - lengths)[piece], n)]
        at = np.append(0, np.cumsum(n))[first]
        run = runs.indices.to_numpy(zero_copy_only=False)
        n = np.diff(at)[run]
        before = np.append(0, np.cumsum(n))
        return flat[spread(at[:-1][run], n)], before[np.searchsorted(start, off)]

    def encode(self, text: str) -> bytes:
        """The ids, little-endian, 32 bits each."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(raw, np.array([0, len(raw)]))[0].astype("<u4").tobytes()


def _cut_utf8(raw: bytes) -> tuple[str, bytes]:
    """The text of the whole characters and the bytes of an unfinished last one."""
    for back in range(1, min(3, len(raw)) + 1):
        b = raw[-back]
        if b >= 0xC0:
            need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            if back < need:
                try:
                    (raw[-back:] + b"\x80" * (need - back)).decode()
                except UnicodeDecodeError:
                    # such bytes may still be good with other continuations: E0, ED, F0 and F4 narrow the next byte
                    if back > 1 or b in (0xC0, 0xC1) or b > 0xF4:
                        break
                return raw[:-back].decode("utf-8", "replace"), raw[-back:]
            break
        if b < 0x80:
            break
    return raw.decode("utf-8", "replace"), b""


class Decoder:
    """Ids to text, token by token; feed() may be called again and again."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {r: t for t, r in ranks.items()}
        self.states: list[bytes] = [b""]
        self.number: dict[bytes, int] = {b"": 0}
        self.moves: list[dict[int, tuple[str, int]]] = [{}]
        self.state = 0
        # the bytes of all tokens by id, one after another; and which lead from the first state to itself
        size = max(self.tokens, default=-1) + 1
        self.length = np.fromiter((len(self.tokens.get(i, b"")) for i in range(size)), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.plain = np.fromiter((_is_utf8(self.tokens.get(i, b"\xff")) for i in range(size)), bool, size)

    def decode_all(self, ids: np.ndarray, first: np.ndarray) -> pa.Array:
        """The texts of all id lists.

        Tokens of whole characters give their bytes.  The stretches between them, where tokens end inside
        characters, go through the states; a whole character, like the end of the text, ends a stretch.
        """
        n = self.length[ids]
        data = self.bytes[spread(self.start[ids], n)]
        before = np.append(0, np.cumsum(n))
        odd = np.flatnonzero(~self.plain[ids])
        bounds = before[first]
        if len(odd):
            opens = np.ones(len(odd), bool)
            opens[1:] = odd[1:] != odd[:-1] + 1
            begins = np.zeros(len(ids) + 1, bool)
            begins[first] = True
            opens |= begins[odd]
            at = np.flatnonzero(opens)
            parts, shift, done = [], np.zeros(len(before), np.int64), 0
            for i, j in zip(odd[at].tolist(), (odd[np.append(at[1:], len(odd)) - 1] + 1).tolist()):
                whole = (self.feed(ids[i:j].tolist()) + self.finish()).encode()
                a, b = int(before[i]), int(before[j])
                if len(whole) != b - a or whole != data[a:b].tobytes():  # bytes that are no UTF-8
                    parts += [data[done:a].tobytes(), whole]
                    shift[j:] += len(whole) - (b - a)
                    done = b
            if parts:
                data = np.frombuffer(b"".join([*parts, data[done:].tobytes()]), np.uint8)
                bounds = bounds + shift[first]
        return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))

    def feed(self, ids: Iterable[int]) -> str:
        out: list[str] = []
        state = self.state
        for i in ids:
            move = self.moves[state].get(i)
            if move is None:
                text, rest = _cut_utf8(self.states[state] + self.tokens[i])
                to = self.number.setdefault(rest, len(self.states))
                if to == len(self.states):
                    self.states.append(rest)
                    self.moves.append({})
                move = self.moves[state][i] = (text, to)
            out.append(move[0])
            state = move[1]
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest, self.state = self.states[self.state], 0
        return rest.decode("utf-8", "replace")


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


_kept: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def _coders(ranks_path: str, pattern: str, ranks) -> tuple[Encoder, Decoder]:
    """One pair for each worker process: what it has compiled serves all its tasks."""
    key = (ranks_path, pattern)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(ranks.value, pattern), Decoder(ranks.value)
    return _kept[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the text decoded from them."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        encoder, decoder = _coders(ranks_path, pattern, ranks)
        collected = gc.isenabled()
        gc.disable()  # the tables hold no cycles, and passing over them again and again is slow
        try:
            for b in batches:
                buf, off = tk.text_buffer(b.column(1))
                for i, j in tk.chunks(off, PASS_BYTES):
                    ids, first = encoder.encode_all(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                    raw = _binary(ids.astype("<u4").view(np.uint8), 4 * first)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), raw.cast(pa.binary()), decoder.decode_all(ids, first).cast(pa.string())], ["doc_id", "ids", "decoded"])
        finally:
            if collected:
                gc.enable()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
