"""Alignment of two tokenizers: groups that end together, links of tokens that overlap, and how many documents hold each pair.

Neither tokenizer joins what stands on both sides of a space between two characters that are not white.  So texts are cut there into runs, and
the runs of a batch are made distinct: tokens, links and groups of a run are the same wherever it stands.

DuckDB aligns them, in each Arrow partition.  The tokens of both sides are interval tables over the bytes of all distinct runs, one after another.  Two intervals overlap if
one holds the other's start: an ASOF join finds, for each token of the one side, the token of the other that holds its start; a second one, with the range as a condition, the tokens of the
other that start within it.  Ends that both sides have close a group; window sums over them number the groups.  A join of documents with their runs' links
gives each document's pairs, and partial counts of these are merged in Spark; what counts a document needs comes back by a join on the pair, in which a list of pairs is broadcast only up to a number of rows.

Defined results.  Null and empty texts, and texts that do not come back from the tokens of both sides byte by byte (those that hold U+2581, which
one side writes for a space), have no tokens: zeros and an empty string.  Rows that repeat, or share a doc_id, count each as a document.  An empty table gives no rows; texts are taken whole,
a very long one alone.  A null doc_id stays null.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .bpe import spread, white_bytes
from .cluster import cut, small_batches

#: Bytes of text that are aligned at a time (a longer single text goes alone); pairs that a task counts before it hands them on.
PASS_BYTES, PAIRS = 2 << 20, 400_000
#: Pairs, of some thirty bytes each, up to which their counts are broadcast.
BROADCAST_PAIRS = 2_000_000
#: Runs whose alignment a worker keeps, some 400 bytes each, and runs that are aligned at a time (those of one batch are all kept).
KEPT, AT_ONCE = 250_000, 1 << 14

#: Runs that may be encoded side by side: a space and letters and signs up to U+024F, none of them white.
PLAIN = re.compile(" [!-~\u00a1-\u024f]+")

#: ids of some runs, one after another, and the number of each run's.
Encoded = tuple[np.ndarray, np.ndarray]


class Side:
    """One tokenizer: ids of runs, each of which begins with a space, and the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], tokens: list[bytes], cuts: bool, together: bool):
        self.encode, self.cuts, self.together = encode, cuts, together
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[spread(self.start[ids], self.length[ids])]

    def ids(self, runs: list[str]) -> Encoded:
        """Where it is faster, runs without white space but the first are encoded side by side, as in a text."""
        side_by_side = [PLAIN.fullmatch(r) is not None for r in runs] if self.cuts and self.together else [False] * len(runs)
        flat: list[np.ndarray] = []
        counts = np.zeros(len(runs), np.int64)
        place = np.flatnonzero(side_by_side)
        for k in range(0, len(place), 1 << 15):
            part = place[k : k + (1 << 15)]
            texts = [runs[i] for i in part.tolist()]
            (found,) = self.encode(["".join(texts)])
            ids = np.array(found, np.int64)
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, texts)), np.int64, len(texts)))
            at = np.cumsum(self.length[ids])
            last = np.searchsorted(at, ends)
            if last[-1] >= len(at) or not np.array_equal(at[last], ends):
                side_by_side = [False] * len(runs)  # tokens that cross: one by one
                flat, place = [], place[:0]
                break
            counts[part] = np.diff(last + 1, prepend=0)
            flat.append(ids)
        alone = np.flatnonzero(~np.array(side_by_side, bool))
        lists = self.encode([runs[i] for i in alone.tolist()]) if len(alone) else []
        counts[alone] = np.fromiter(map(len, lists), np.int64, len(lists))
        flat.append(np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists))))
        # back to the order of the runs
        order = np.concatenate([place, alone]).astype(np.int64)
        ids, size = np.concatenate(flat), counts[order]
        begin = np.empty(len(runs), np.int64)
        begin[order] = np.cumsum(size) - size
        return ids[spread(begin, counts)], counts


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level_side(path: str) -> Side:
    """A byte-level BPE of a JSON file.  Its pattern leaves a space with what follows it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the one it has
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    with open(path) as f:
        made = json.load(f)
    letters = byte_letters()
    vocabulary: dict[str, int] = made["model"]["vocab"]
    tokens = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for entry, i in vocabulary.items():
        tokens[i] = bytes(letters[c] for c in entry)
    for added in made["added_tokens"]:
        tokens[added["id"]] = added["content"].encode()
    how = made["pre_tokenizer"] or {}
    cuts = made["normalizer"] is None and how.get("type") == "ByteLevel" and how.get("use_regex", False) and not how.get("add_prefix_space", True)

    def encode(runs: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch(runs, add_special_tokens=False)]

    # Merging by rank of what is joined is merging by the listed pairs if each token comes of its own bytes: the first pair that is not listed and would be joined
    # had no merge over its ends yet, so that merging its bytes alone would stop there as well.
    special = {added["id"] for added in made["added_tokens"]}
    ranked = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
    in_order = [vocabulary["".join(m)] for m in ranked]
    whole = all(len(tokenizer.model.tokenize(entry)) == 1 for entry, i in vocabulary.items() if i not in special)
    if not (cuts and whole and in_order == sorted(in_order) and len(in_order) + 256 == len(vocabulary.keys() - {x["content"] for x in made["added_tokens"]})):
        return Side(encode, tokens, cuts, True)
    import tiktoken

    ranks = {tokens[i]: i for i in vocabulary.values() if i not in special}
    ranked_encoder = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_either(runs: list[str]) -> list[list[int]]:
        """Letters beyond U+024F go to the library itself: the two differ in the age of their tables."""
        old = [max(r) < "\u0250" for r in runs]
        rest = iter(encode([r for r, is_old in zip(runs, old) if not is_old]))
        return [ranked_encoder.encode_ordinary(r) if is_old else next(rest) for r, is_old in zip(runs, old)]

    return Side(encode_either, tokens, cuts, True)


def piece_side(path: str) -> Side:
    """A piece model that writes spaces as U+2581 and puts one before the text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    tokens = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
    # no piece goes on past a space after another character
    cuts = not any("▁" in x.lstrip("▁") for x in pieces)
    return Side(lambda runs: model.encode([r[1:] for r in runs], num_threads=1), tokens, cuts, False)


def cut_runs(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the runs: of each text, and of each space between two characters that are not white."""
    white = white_bytes(buf)
    begin = np.zeros(len(buf) + 1, bool)
    space = np.flatnonzero(buf == 0x20)
    space = space[(space > 0) & (space < len(buf) - 1)]
    begin[space[~(white[space - 1] | white[space + 1])]] = True
    # a text begins with a space, and what stands before it is another's; a space that ends a text begins nothing
    last = off[1:][np.diff(off) > 1] - 1
    begin[last[buf[last] == 0x20]] = False
    begin[off] = True
    return np.flatnonzero(begin[: len(buf)])


class Column:
    """Values that are added at the end, in room that doubles; with bounds, those of each run."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(self.n + 2 * len(more), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


class Known:
    """Aligned runs: their number by text; n_a, n_b, n_groups, good; links a, b, n and the spelt groups, with where those of each run begin and how many there are."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.columns = {c: Column(np.int32) for c in ("n_a", "n_b", "n_groups", "links", "letters", "a", "b", "n")} | {c: Column(np.int64) for c in ("first_link", "first_letter")}
        self.columns |= {"good": Column(bool), "spelt": Column(np.uint8)}

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name].values[: self.columns[name].n]


class Aligner:
    """Tokens of distinct runs on both sides, and their alignment in DuckDB.  Runs that are known are not aligned again."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.known = Known()
        # nothing is written to a disk: batches are bounded
        self.db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": False})
        self.db.execute("create table partial (a int, b int, n bigint)")
        self.waiting = 0

    def numbers(self, runs: list[str]) -> np.ndarray:
        if len(self.known.number) + len(runs) > KEPT:
            self.known = Known()
        get = self.known.number.get
        out = np.fromiter((get(r, -1) for r in runs), np.int64, len(runs))
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = len(self.known["good"]) + np.arange(len(new))
            for k in range(0, len(new), AT_ONCE):
                self.learn([runs[i] for i in new[k : k + AT_ONCE].tolist()])
                pa.default_memory_pool().release_unused()
        return out

    def learn(self, runs: list[str]) -> None:
        raw, off = tk.text_buffer(pa.array(runs, pa.large_string()))
        size, good, columns = np.diff(off), np.ones(len(runs), bool), []
        for side in self.sides:
            ids, counts = side.ids(runs)
            of = np.repeat(np.arange(len(runs)), counts)
            good &= np.bincount(of, side.length[ids], minlength=len(runs)) == size
            columns.append((ids, of))
        for side, (ids, of) in zip(self.sides, columns):
            at = np.flatnonzero(good)
            if not np.array_equal(side.spell(ids[good[of]]), raw[spread(off[at], size[at])]):  # the same lengths and other bytes: run by run
                for r in at.tolist():
                    good[r] = side.spell(ids[of == r]).tobytes() == raw[off[r] : off[r + 1]].tobytes()
        counts = {}
        for name, side, (ids, of) in zip("ab", self.sides, columns):
            mine = good[of]
            ids, of = ids[mine], of[mine]
            end = np.cumsum(side.length[ids])  # bytes of all runs that have tokens
            self.db.register("given", pa.table({"run": of.astype(np.int32), "id": ids.astype(np.int32), "s": end - side.length[ids], "e": end}))
            self.db.execute(f"create or replace temp table t{name} as select * from given")
            counts[f"n_{name}"] = np.bincount(of, minlength=len(runs))
        links = _arrow(self.db, LINKS)
        tokens = _arrow(self.db, GROUPS)
        of, s, g, side = (tokens[c].to_numpy() for c in ("run", "s", "g", "side"))
        order = np.argsort((2 * g + side) << 32 | s, kind="stable")  # by group, side, place; a batch has fewer than 2**31 tokens and bytes
        of, g, side = of[order], g[order], side[order]
        # an id is followed by ; if it is the last of its group, by | if it is the last of its side there
        new_group, new_side = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (g, side))
        sign = pa.array([",", "|", ";"]).take(pa.array(np.where(new_group, 2, np.where(new_side, 1, 0))))
        spelt, bounds = tk.text_buffer(pc.binary_join_element_wise(tokens["id"].take(pa.array(order)).cast(pa.string()), sign, "").cast(pa.large_binary()))
        counts["n_groups"] = np.bincount(of[new_group], minlength=len(runs))
        known, run = self.known.columns, links["run"].to_numpy()
        for name, values, first, size in (("spelt", spelt, "first_letter", np.diff(bounds[np.searchsorted(of, np.arange(len(runs) + 1))])), ("a", links["a"], "first_link", np.bincount(run, minlength=len(runs)))):
            counts["letters" if name == "spelt" else "links"] = size
            known[first].add(known[name].n + np.cumsum(size) - size)
            known[name].add(np.asarray(values))
        known["b"].add(links["b"].to_numpy())
        known["n"].add(links["n"].to_numpy())
        known["good"].add(good)
        for name, values in counts.items():
            known[name].add(values)
        at = len(self.known.number)
        self.known.number |= {r: at + k for k, r in enumerate(runs)}

    def align(self, rows: int, text: np.ndarray, run: np.ndarray, runs: pa.Array) -> dict[str, pa.Array]:
        """Digest columns of some texts and the pairs of each.  text, run: of each occurrence, in order."""
        number, known = self.numbers(runs.cast(pa.large_string()).to_pylist()), self.known
        # a text with a run that does not come back has no tokens
        whole = np.ones(rows, bool)
        whole[text[~known["good"][number][run]]] = False
        keep = whole[text]
        text, run = text[keep], run[keep]
        out = {c: pa.array(np.bincount(text, known[c][number[run]], minlength=rows).astype(np.int64)) for c in ("n_a", "n_b", "n_groups")}
        out["groups_sha256"] = pa.array(self._digests(rows, text, number[run]), pa.string())
        # the pairs of each text
        size = known["links"][number].astype(np.int64)
        at = spread(known["first_link"][number], size)
        self.db.register("links", pa.table({"run": np.repeat(np.arange(len(number), dtype=np.int32), size)} | {c: known[c][at] for c in "abn"}))
        pair, times = np.unique(text * len(number) + run, return_counts=True)
        self.db.register("occ", pa.table({"row": (pair // len(number)).astype(np.int32), "run": (pair % len(number)).astype(np.int32), "times": times.astype(np.int32)}))
        self.db.execute("create or replace temp table pairs as " + PAIRS_OF_ROWS)
        self.db.execute("insert into partial select a, b, count(*) from pairs group by all")
        self.waiting += self.db.execute("select count(*) from partial").fetchall()[0][0]
        pairs = _arrow(self.db, "select * from pairs order by row")
        row = pairs["row"].to_numpy()
        first = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
        out["n_links"] = pa.array(tk.per_text_sum(pairs["n"].to_numpy().astype(np.int64), first))
        out["pairs"] = pa.ListArray.from_arrays(pa.array(first), _structs(pairs))
        return out

    def _digests(self, rows: int, text: np.ndarray, number: np.ndarray) -> list[str]:
        spelt, begin, size = self.known["spelt"], self.known["first_letter"], self.known["letters"].astype(np.int64)
        at = np.searchsorted(text, np.arange(rows + 1)).tolist()
        digests = [hashlib.sha256() for _ in range(rows)]
        step = 1 << 17
        for k in range(0, len(text), step):
            part = number[k : k + step]
            raw = spelt[spread(begin[part], size[part])].tobytes()
            ends = np.append(0, np.cumsum(size[part])).tolist()
            for r in range(int(text[k]), int(text[k + len(part) - 1]) + 1):
                i, j = max(at[r], k) - k, min(at[r + 1], k + len(part)) - k
                # no ; after the last group
                digests[r].update(raw[ends[i] : ends[j] - (i < j and j + k == at[r + 1])])
        return [d.hexdigest() if at[r] < at[r + 1] else "" for r, d in enumerate(digests)]

    def counted(self) -> dict[str, pa.Array]:
        out = _arrow(self.db, "select a, b, sum(n)::int as n from partial group by all")
        self.db.execute("delete from partial")
        self.waiting = 0
        return out


def _arrow(db: duckdb.DuckDBPyConnection, query: str) -> dict[str, pa.Array]:
    found = db.sql(query).to_arrow_table()
    return {c: pa.concat_arrays(found[c].chunks) if found[c].num_chunks else pa.array([], found[c].type) for c in found.column_names}


def _structs(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([columns[c] for c in "abn"], list("abn"))


#: Each overlap once: by the start of the one's token within the other's, or by that of the other's strictly within the one's: of the last token that starts before it, if it reaches as far.
LINKS = """
with held as (select ta.run, ta.id as a, tb.id as b from ta asof join tb on ta.s >= tb.s),
within as (select ta.run, ta.id as a, tb.id as b from tb asof join ta on tb.s > ta.s where tb.s < ta.e)
select run, a, b, count(*)::int as n from (from held union all from within) group by all order by run"""

#: The pairs of each text, by the links of its runs.
PAIRS_OF_ROWS = "select row, a, b, sum(links.n * times)::int as n from occ join links using (run) group by all"

#: All tokens in the order of their groups: a group is told by the ends before it that both sides have.
GROUPS = """
with shared as (select ta.e from ta join tb on ta.e = tb.e),
sides as (select run, id, s, e, 0 as side from ta union all select run, id, s, e, 1 from tb),
marked as (select sides.*, (shared.e is not null)::int as ends from sides left join shared on sides.e = shared.e),
numbered as (select run, id, s, side, sum(ends) over (partition by side order by s rows unbounded preceding) - ends as g from marked)
select run, id, s, side, g::bigint as g from numbered"""

_FIELDS = ["doc_id", "rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
_SCHEMA = "doc_id long, rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,n:int>>"

_aligners: dict[tuple[str, str], Aligner] = {}


def _aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker process."""
    key = (a_path, b_path)
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(byte_level_side(a_path), piece_side(b_path))
    return _aligners[key]


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document, with a number of its own, and rows without one that hold the documents of each pair, in parts."""

    def run(batches):
        aligner = _aligner(a_path, b_path)
        aligner.counted()  # what a task that failed has left
        at = TaskContext.get().partitionId() << 33
        none = lambda kind: pa.nulls(1, kind)
        empty = pa.array([None], pa.string())

        def counts():
            flat = _structs(aligner.counted())
            return pa.RecordBatch.from_arrays([*[none(pa.int64())] * 6, empty, pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], _FIELDS)

        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off, PASS_BYTES):
                size = np.diff(off[i : j + 1])
                some = np.flatnonzero(size)
                # a space before each text that is not empty
                spaced = np.full(int(size.sum()) + len(some), 32, np.uint8)
                bounds = np.append(0, np.cumsum(size[some] + 1))
                inner = np.ones(len(spaced), bool)
                inner[bounds[:-1]] = False
                spaced[inner] = buf[off[i] : off[j]]
                start = cut_runs(spaced, bounds) if all(s.cuts for s in aligner.sides) else bounds[:-1]
                ends = np.append(start, len(spaced)).astype(np.int64)
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(spaced)]).dictionary_encode()
                out = aligner.align(j - i, some[np.searchsorted(bounds, start, "right") - 1], made.indices.to_numpy(zero_copy_only=False).astype(np.int64), made.dictionary)
                out |= {"doc_id": b.column(0).slice(i, j - i), "rid": pa.array(np.arange(at, at + j - i))}
                at += j - i
                yield pa.RecordBatch.from_arrays([out[f] for f in _FIELDS], _FIELDS)
                if aligner.waiting > PAIRS:
                    yield counts()
        if aligner.waiting:
            yield counts()

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, held (documents that hold the pair), best (no pair of the same a is held by more)."""
    held = rows.where("rid is null").select(F.inline("pairs")).groupBy("a", "b").agg(F.sum("n").alias("held"))
    held = cut(held)
    most = held.groupBy("a").agg(F.max("held").alias("most"))
    return held.join(most, "a").select("a", "b", "held", (F.col("held") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The contract's columns for each row of documents."""
    small_batches(docs.sparkSession)
    rows = cut(aligned(docs, a_path, b_path))
    counts = cut(pair_counts(rows))
    few = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts
    own = rows.where("rid is not null")
    sums = own.select("rid", F.inline("pairs")).join(few, ["a", "b"]).groupBy("rid").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("held")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = own.drop("pairs").join(sums, "rid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
