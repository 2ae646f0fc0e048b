"""Spelling variants: words that differ by one letter, their forms and roots, by a symmetric-delete join.

Words are counted over the whole corpus.  Every word then emits itself and its distinct single deletions; words that
share one of these meet in an equi-join and are kept if their distance is exactly one.  Two words at distance one share exactly one of
their keys: the shorter word where a letter is inserted, what is left without the letter where one is replaced.  So near words are
counted without making them distinct first, and as a key has at most (length + 1) x letters words, no group grows with the corpus.

A word's form is its most frequent near word, if that is ten times as frequent; as counts grow tenfold on each step, chains of forms are
short, and pointers are doubled in a few joins.

Keys are 64-bit hashes, made from prefix sums, so that a word of a million letters emits a million keys and not as many copies of
itself; every pair is verified on the words.  A word of over 64 bytes goes by a digest of it; it is fetched for the pairs that it may be in.

Defined results.  Null and empty texts have no words; a null doc_id is the empty text where it is hashed; repeated rows
count as often as they stand there.  An empty table has no words.  Texts and words may be of any length.  Of near words with the same count the first in code-point
order is the form.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .cluster import cut, small_batches

#: The noise of the contract: of the runs, one in so many loses a code point.
EVERY = 31
#: Code points and occurrences of a word at least, and times a form must be as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: Bytes of a word that goes by itself.
LONG = 64
_VECTOR = 48


def letter_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes are of A-Z, a-z or U+00C0 to U+00FF: these last are C3 and one more byte."""
    out = ((buf >= 0x41) & (buf <= 0x5A)) | ((buf >= 0x61) & (buf <= 0x7A)) | (buf == 0xC3)
    out[1:] |= buf[:-1] == 0xC3
    return out


def _crc_step() -> np.ndarray:
    """What one zero byte makes of the low byte of a CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _crc_step()


def _strings(values: np.ndarray, off: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])


def runs_of(buf: np.ndarray, off: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct lower-cased runs, the run and the text of each occurrence)."""
    inside = letter_bytes(buf)
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    start = np.flatnonzero(begin)
    # the bytes of the runs, one run after another
    place = np.cumsum(inside)
    ends = np.append(place[start] - 1, place[-1] if len(place) else 0)
    found = _strings(tk.LOWER[buf[inside]], ends).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.searchsorted(off, start, "right") - 1


def noisy_counts(ids: list, buf: np.ndarray, off: np.ndarray) -> dict[bytes, int]:
    """Occurrences of the words of some texts, after one in EVERY runs, by the hash of id and run, has lost a code point."""
    runs, run, text = runs_of(buf, off)
    if not runs:
        return {}
    size = np.fromiter(map(len, runs), np.int64, len(runs))
    crc = np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
    heads = np.fromiter((zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids), np.uint32, len(ids))
    # a CRC of two parts is that of the first, moved on by as many zero bytes as the second has, and that of the second
    moved = np.empty((_VECTOR + 1, len(ids)), np.uint32)
    moved[0] = heads
    for k in range(_VECTOR):
        moved[k + 1] = (moved[k] >> np.uint32(8)) ^ _STEP[moved[k] & np.uint32(255)]
    n = size[run]
    h = moved[np.minimum(n, _VECTOR), text] ^ crc[run]
    for k in np.flatnonzero(n > _VECTOR).tolist():
        h[k] = zlib.crc32(runs[run[k]], int(heads[text[k]]))
    hit = np.flatnonzero(h % EVERY == 0)
    times = np.bincount(run, minlength=len(runs)) - np.bincount(run[hit], minlength=len(runs))
    # letters of two bytes are one code point
    length = np.fromiter((len(r) - r.count(0xC3) for r in runs), np.int64, len(runs))
    out = {runs[k]: int(times[k]) for k in np.flatnonzero((length >= LEAST_LENGTH) & (times > 0)).tolist()}
    hit = hit[length[run[hit]] > LEAST_LENGTH]
    at = h[hit] % length[run[hit]]
    for k, i in zip(run[hit].tolist(), at.tolist()):
        letters = runs[k].decode()
        word = (letters[:i] + letters[i + 1 :]).encode()
        out[word] = out.get(word, 0) + 1
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off, 8 * tk.CHUNK_BYTES):
                counts = noisy_counts(b.column(0).slice(i, j - i).to_pylist(), buf[off[i] : off[j]], off[i : j + 1] - off[i])
                words = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def deletion_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word): of each word itself and of its distinct single deletions."""
    n = len(off) - 1
    sums = tk.byte_sums(buf)
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    word = np.searchsorted(off, start, "right") - 1
    end = np.append(start[1:], len(buf))
    h = tk.span_hash_without(sums, off[word], off[word + 1], start, end)
    # deleting any of several equal letters in a row gives the same
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word[1:] == word[:-1])
    own = tk.span_hash(sums, off[:-1], off[1:])
    return np.concatenate([own, h[~same]]), np.concatenate([np.arange(n), word[~same]])


def keys(words: DataFrame) -> DataFrame:
    """key, name, n: each word by the hashes of itself and of its deletions."""

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(0))
            for i, j in tk.chunks(off, tk.CHUNK_BYTES // 4):
                h, word = deletion_hashes(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                names = b.column(0).slice(i, j - i)
                long = np.flatnonzero(np.diff(off[i : j + 1]) > LONG)
                if len(long):
                    names = names.to_pylist()
                    for k in long.tolist():
                        names[k] = "#" + hashlib.sha256(names[k].encode()).hexdigest()
                    names = pa.array(names, pa.string())
                for at in range(0, len(h), 1 << 17):
                    part = pa.array(word[at : at + (1 << 17)])
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + (1 << 17)].view(np.int64)), names.take(part), b.column(1).slice(i, j - i).take(part)], ["key", "name", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, name string, n long")


def _name(word: Column) -> Column:
    """What a word goes by; no word holds the sign before a digest."""
    return F.when(F.octet_length(word) > LONG, F.concat(F.lit("#"), F.sha2(word.cast("binary"), 256))).otherwise(word)


def near_words(words: DataFrame) -> DataFrame:
    """name, near (word), near_n: all pairs of words at distance one, both ways, by name of the first."""
    all_keys = cut(keys(words))
    is_long = F.col("name").startswith("#")
    other = all_keys.select("key", F.col("name").alias("near"), F.col("n").alias("near_n"))
    short = all_keys.where(~is_long).join(other.where(~F.col("near").startswith("#")), "key").where("name != near")
    pairs = short.where(F.levenshtein("name", "near", 1) == 1).select("name", "near", "near_n")
    long = words.where(F.octet_length("word") > LONG)
    if long.isEmpty():
        return pairs
    # pairs with a long word: their words are fetched before they are compared
    far = all_keys.where(is_long).join(other, "key").where("name != near")
    far = far.unionByName(all_keys.where(~is_long).join(other.where(F.col("near").startswith("#")), "key")).select("name", "near", "near_n").distinct()
    spelt = long.select(_name(F.col("word")).alias("as"), "word")
    for column in ("name", "near"):
        far = far.join(spelt.withColumnsRenamed({"as": column, "word": f"{column}_word"}), column, "left").withColumn(f"{column}_word", F.coalesce(f"{column}_word", column))
    far = far.where(F.levenshtein("name_word", "near_word", 1) == 1)
    return pairs.unionByName(far.select("name", F.col("near_word").alias("near"), "near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """name, root (a name): where each form chain of (name, at) ends.  Pointers are doubled, so that rounds go with the logarithm of the longest."""
    now = cut(forms)
    while True:
        onward = now.select(F.col("name").alias("at"), F.col("at").alias("further"))
        later = cut(now.join(onward, "at", "left").select("name", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")))
        now = later.select("name", "at")
        if later.where("moved").isEmpty():
            return now.withColumnRenamed("at", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of documents."""
    words = cut(word_counts(docs))
    near = near_words(words).groupBy("name").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    named = words.withColumn("name", _name(F.col("word")))
    enough = -F.col("best.less") >= TIMES * F.col("n")
    formed = named.join(near, "name", "left").select("name", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    formed = cut(formed)
    ends = roots(formed.where("form is not null").select("name", _name(F.col("form")).alias("at")))
    out = formed.join(ends, "name", "left").withColumn("root", F.coalesce("root", "name"))
    long = named.where(F.col("name").startswith("#")).select(F.col("name").alias("root"), F.col("word").alias("spelt"))
    if not long.isEmpty():
        out = out.join(long, "root", "left").withColumn("root", F.coalesce("spelt", "root"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
