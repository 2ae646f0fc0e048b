"""Quality rules, line first.

Every line of a text is judged by itself.  Punctuation rules: symbol-heavy lines, shouting, and lines that break off
in dots fail.  Navigation rules: lines of bars fail, and runs of very short lines without end punctuation, as menus are.
Boilerplate rules: repeats of earlier lines fail, and lines that boilerplate phrases make up for the most part; a
phrase in passing does no harm.  Lines that fail are removed; then a document that loses too much of its text is
rejected, as is one that fails the base rules (too few words, too many words in repeated eight-word windows).

Defined results.  Null or empty text: zero counts, base_failed, not kept.  A text
of one long line is one line.  Repeated rows are judged alike; what stands in other rows, or in which order and
batches they come, changes nothing.
Columns other than the two named are not read, so clashing names do no harm.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk
from .cluster import small_batches

#: The characters that the contract counts as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Thresholds; shares are of a line's or a text's words.

    menu_lines: lines of at most menu_words words without end punctuation that make a menu, side by side;
    words_per_phrase: words that a line has at most for each boilerplate phrase in it if it fails.
    """

    min_words: int = 20
    max_repeat_percent: int = 30
    symbols_per_word: float = 0.5
    bars_per_word: float = 0.25
    bangs_per_word: float = 0.5
    menu_lines: int = 4
    menu_words: int = 3
    words_per_phrase: int = 15
    max_lost: float = 0.5
    boilerplate: tuple[str, ...] = (
        "cookie", "javascript", "all rights reserved", "released under the", "terms of use", "terms of service",
        "privacy policy", "subscribe to our", "sign up for", "click here", "skip to content", "lorem ipsum",
    )


_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_IS_LEAD = (np.arange(256) & 0xC0) != 0x80
#: Last bytes of a line that ends a sentence or introduces something: . ! ? : ; , and closing quotes and brackets.
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?:;,\"')]}", np.uint8)) | (np.arange(256) >= 128)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_window_words(w: tk.Words, length: int = 8) -> np.ndarray:
    """Which words lie in a window that its text holds twice or more."""
    starts = tk.window_starts(w.first, length)
    text = w.text_of()
    h = tk.sequence_hash(tk.sequence_sums(w.hash), starts, length)
    key = h ^ tk.mix(text[starts].astype(np.uint64) + np.uint64(7))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    equal = key[order][1:] == key[order][:-1]
    same[order[1:]] |= equal
    same[order[:-1]] |= equal
    return tk.covered(len(w), starts[same], length)


def _phrases_in(low: np.ndarray, off: np.ndarray, start: np.ndarray, phrases: tuple[str, ...]) -> np.ndarray:
    """The number of phrases in each line; the lines begin at start.  Texts are held apart, so that none is found across two."""
    apart = np.insert(low, off[1:-1], 10).tobytes()
    found = np.fromiter((m.start() for m in re.finditer(b"|".join(re.escape(p.encode()) for p in phrases), apart)), np.int64)
    text = np.searchsorted(off[:-1] + np.arange(len(off) - 1), found, "right") - 1
    return np.bincount(np.searchsorted(start, found - text, "right") - 1, minlength=len(start)) if len(found) else np.zeros(len(start), np.int64)


def judge(buf: np.ndarray, off: np.ndarray, rules: Rules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Per text: counts and verdicts; and of the lines: start, end, kept."""
    w = tk.Words(buf, off, tk.SPACE)
    n_words = w.per_text()
    low = tk.LOWER[buf]

    def count_in(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums

    lead = count_in(_IS_LEAD[buf])
    symbols, bars, bangs = count_in(_IS_SYMBOL[buf]), count_in(buf == ord("|")), count_in(buf == ord("!"))
    out = {"n_words": n_words, "word_chars": tk.per_text_sum(lead[w.end] - lead[w.start], w.first)}
    out["n_symbols"] = symbols[off[1:]] - symbols[off[:-1]]

    # Lines: split at \n within each text.
    breaks = np.flatnonzero(buf == 10)
    texts = len(off) - 1
    start = np.concatenate([off[:-1], breaks + 1])
    end = np.concatenate([breaks, off[1:]])
    start, end = np.sort(start, kind="stable"), np.sort(end, kind="stable")
    line_text = np.repeat(np.arange(texts), 1 + np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]))
    first_word = np.searchsorted(w.start, start)
    words = np.searchsorted(w.start, end) - first_word
    has = words > 0
    h = tk.span_hash(w.sums, start, end) ^ tk.mix(line_text.astype(np.uint64) + np.uint64(11))
    dup = np.zeros(len(start), bool)
    at = np.flatnonzero(has)
    if len(at):
        order = at[np.argsort(h[at], kind="stable")]
        dup[order[1:]] = h[order][1:] == h[order][:-1]
    out["n_dup_lines"] = np.bincount(line_text[dup], minlength=texts).astype(np.int64)
    out["n_repeat_words"] = tk.per_text_sum(repeated_window_words(w), w.first)

    sums = lambda s: s[end] - s[start]
    fails = dup | (sums(symbols) > rules.symbols_per_word * words) | (sums(bangs) > rules.bangs_per_word * words)
    fails |= (sums(bars) >= 2) & (sums(bars) >= rules.bars_per_word * words)
    fails |= _phrases_in(low, off, start, rules.boilerplate) * rules.words_per_phrase >= np.maximum(words, 1)
    # the end of a line's last word
    last = w.end[np.maximum(first_word + words - 1, 0)] if len(w) else np.zeros(len(start), np.int64)
    tail = buf[np.maximum(last - 1, 0)] if len(buf) else np.zeros(len(start), np.uint8)
    if len(buf):
        dots = (tail == ord(".")) & (buf[np.maximum(last - 2, 0)] == ord(".")) & (buf[np.maximum(last - 3, 0)] == ord(".")) & (last - start >= 3)
        dots |= (tail == 0xA6) & (buf[np.maximum(last - 2, 0)] == 0x80) & (buf[np.maximum(last - 3, 0)] == 0xE2) & (last - start >= 3)
        fails |= dots
    # menus: runs of short open lines among the lines that have words
    brief = (words[at] <= rules.menu_words) & ~_ENDS[tail[at]]
    turn = np.ones(len(at), bool)
    turn[1:] = (brief[1:] != brief[:-1]) | (line_text[at][1:] != line_text[at][:-1])
    run = np.cumsum(turn) - 1
    fails[at] |= brief & (np.bincount(run)[run] >= rules.menu_lines if len(at) else False)
    fails &= has
    lost = np.bincount(line_text, np.where(fails, words, 0), minlength=texts).astype(np.int64)
    out["n_lines_removed"] = np.bincount(line_text[fails], minlength=texts).astype(np.int64)
    out["n_words_left"] = n_words - lost
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    out["kept"] = ~out["base_failed"] & (lost <= rules.max_lost * n_words) & (n_words - lost >= rules.min_words)
    return out, np.stack([start, end, line_text]), ~fails, np.array(line_text)


def cleaned(buf: np.ndarray, lines: np.ndarray, good: np.ndarray, texts: int) -> list[str]:
    """Each text without the lines that fail."""
    raw, parts = buf.tobytes(), [[] for _ in range(texts)]
    for s, e, t in lines[:, good].T.tolist():
        parts[t].append(raw[s:e])
    return [b"\n".join(p).decode("utf-8", "replace") for p in parts]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_left long"


def quality(docs: DataFrame, rules: Rules | None = None, with_text: bool = False) -> DataFrame:
    """Counts and verdict of each document; with_text: also clean_text."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(1))
            for i, j in tk.chunks(off):
                part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                out, lines, good, _ = judge(part, rel, rules)
                cols = [b.column(0).slice(i, j - i)]
                cols += [pa.array(out[k]) for k in (*COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_left")]
                names = ["doc_id", *COUNTS, "base_failed", "kept", "n_lines_removed", "n_words_left"]
                if with_text:
                    cols.append(pa.array(cleaned(part, lines, good, j - i), pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", clean_text string" if with_text else ""))


def keep_documents(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The documents that are kept, all columns, without the lines that fail; n_chars follows the text."""
    rules = rules or Rules()
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches):
        for b in batches:
            buf, off = tk.text_buffer(b.column(names.index("text")))
            for i, j in tk.chunks(off):
                part, rel = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                out, lines, good, _ = judge(part, rel, rules)
                texts = pa.array(cleaned(part, lines, good, j - i), pa.string())
                rows = b.slice(i, j - i)
                cols = [texts if n == "text" else rows.column(k) for k, n in enumerate(names)]
                if "n_chars" in names:
                    cols[names.index("n_chars")] = pa.array([len(t) for t in texts.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(out["kept"]))

    return docs.mapInArrow(run, docs.schema)
