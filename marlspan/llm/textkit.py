"""Vectorised text kernels over Arrow string columns.

Texts are handled as one byte buffer with row offsets; words, lines and windows
become index arrays, so no Python object is made per word.  Hashes are 64-bit
polynomials over a random byte table, taken from prefix sums modulo 2**64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time (a longer single text is one chunk).
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256)
#: Separators of `[^\x20\x09-\x0D]+` words.
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` words, on lower-cased text.
NON_ALNUM = (_BYTES <= 0x2F) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
#: A-Z to a-z, all else as it is.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_INV = np.uint64(pow(int(_STEP), -1, 1 << 64))


@lru_cache(maxsize=4)
def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)


_powers: dict[str, np.ndarray] = {}


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the step or of its inverse."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = np.full(size, _STEP_INV if inverse else _STEP, dtype=np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size <= 8 * CHUNK_BYTES:
            _powers[key] = out
        have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose texts come to the limit at most (or are one row)."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of some texts.

    start, end: byte range of each word; first: index of each text's first word,
    with the number of words at its end; hash: of each word.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, separators: np.ndarray, seed: int = 1):
        n = len(buf)
        inside = ~separators[buf]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        edge = off[(off > 0) & (off < n)]
        before[edge] = False
        after[edge - 1] = False
        self.buf, self.off = buf, off
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.sums = byte_sums(buf, seed)
        self.hash = span_hash(self.sums, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.per_text())


def byte_sums(buf: np.ndarray, seed: int = 1) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_byte_table(seed)[buf] * _power(len(buf)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span: the same for the same bytes anywhere."""
    return mix((sums[end] - sums[start]) * _power(len(sums), inverse=True)[start])


def span_hash_without(sums: np.ndarray, start: np.ndarray, end: np.ndarray, gap: np.ndarray, gap_end: np.ndarray) -> np.ndarray:
    """span_hash() of what is left of each span without the bytes from gap to gap_end."""
    back = _power(len(sums), inverse=True)
    return mix((sums[gap] - sums[start] + (sums[end] - sums[gap_end]) * back[gap_end - gap]) * back[start])


def sequence_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which sequence_hash() takes hashes of runs of values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values)), out=out[1:])
    return out


def sequence_hash(sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
    return mix((sums[start + length] - sums[start]) * _power(len(sums), inverse=True)[start] + np.uint64(1))


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Indices of the words at which a window of that length lies within one text."""
    n = int(first[-1]) if len(first) else 0
    if n < length:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    counts = np.diff(first)
    # the last length-1 words of each text start no window
    tail = np.minimum(counts, length - 1)
    ends = first[1:]
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, ends - tail, 1)
    np.add.at(marks, ends, -1)
    ok &= np.cumsum(marks[:-1]) == 0
    return np.flatnonzero(ok)


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n positions lie in a run of that length from one of the starts."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1]) > 0


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each range first[i]:first[i + 1]."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
