"""Portable network graphics in numpy: luma of stored frames, and which grid pixels stay dark in all frames of a clip."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, colours, palette, grey and alpha, colours and alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(raw: bytes):
    if raw[:8] != SIGNATURE:
        raise ValueError("signature")
    at = 8
    while at + 12 <= len(raw):
        (n,) = struct.unpack(">I", raw[at : at + 4])
        kind, body = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n]
        if raw[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError("checksum")
        yield kind, body
        at += 12 + n


def _unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows of a filter's number and filtered bytes; step: bytes of a pixel."""
    out = np.zeros((len(lines), lines.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, line in enumerate(lines):
        kind, data = int(line[0]), line[1:]
        if kind == 0:
            row = data
        elif kind == 1:
            row = np.add.accumulate(np.pad(data, (0, -len(data) % step)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(data)]
        elif kind == 2:
            row = data + above
        elif kind in (3, 4):
            row = np.zeros(len(data), np.uint8)
            done, up = [0] * step, above.tolist()
            corner = [0] * step + up
            for x, value in enumerate(data.tolist()):
                a, b, c = done[x], up[x], corner[x]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                done.append((value + guess) & 255)
            row = np.array(done[step:], np.uint8)
        else:
            raise ValueError("filter")
        out[y] = above = row
    return out


def luma(raw: bytes) -> np.ndarray:
    """Luma of each pixel, 0 to 255, of an image that is not interlaced; ValueError says what is wrong with one."""
    header, palette, data = None, None, b""
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
    if header is None:
        raise ValueError("header")
    width, height, depth, colour, _, _, interlaced = header
    if interlaced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not width or not height:
        raise ValueError("kind")
    channels = CHANNELS[colour]
    try:
        flat = np.frombuffer(zlib.decompress(data), np.uint8)
    except zlib.error:
        raise ValueError("data") from None
    line = -(-width * channels * depth // 8) + 1
    if len(flat) < height * line:
        raise ValueError("data")
    rows = _unfiltered(flat[: height * line].reshape(height, line), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]  # the high bytes
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            rows = rows * (255 // ((1 << depth) - 1))
    pixels = rows.reshape(height, width, channels)
    if colour == 3:
        if palette is None or pixels.max() >= len(palette):
            raise ValueError("palette")
        pixels = palette[pixels[:, :, 0]]
    if pixels.shape[2] < 3:
        return pixels[:, :, 0].copy()
    r, g, b = (pixels[:, :, k].astype(np.uint32) for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16).astype(np.uint8)


def encoded(grey: np.ndarray, level: int = 6) -> bytes:
    """A grey image as a file, each line as the difference from the line above."""
    height, width = grey.shape
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = 2
    lines[:, 1:] = grey - np.concatenate([np.zeros((1, width), np.uint8), grey[:-1]])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def dark_bits(frames: DataFrame, clip: str, content: str, grid: list[tuple[float, float]], below: float = 12.0) -> DataFrame:
    """clip, bits, error of each frame: a bit for each grid pixel whose luma is below the bound, 64 to a number; or what is wrong with the image."""
    u, v = np.rint(np.array(grid, np.float64).reshape(-1, 2).T).astype(np.int64)
    words = -(-len(u) // 64)

    def run(batches):
        for b in batches:
            bits, errors = [], []
            for raw in b.column(1).to_pylist():
                try:
                    image = luma(raw or b"")
                    dark = image[np.clip(v, 0, image.shape[0] - 1), np.clip(u, 0, image.shape[1] - 1)] < below
                    bits.append(np.packbits(np.pad(dark, (0, 64 * words - len(dark))), bitorder="little").view("<i8").tolist())
                    errors.append(None)
                except ValueError as e:
                    bits.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.list_(pa.int64())), pa.array(errors, pa.string())], ["clip", "bits", "error"])

    kind = frames.schema[clip].dataType.simpleString()
    return frames.select(F.col(clip).alias("clip"), F.col(content).alias("content")).mapInArrow(run, f"clip {kind}, bits array<bigint>, error string")


def dark_in_all_frames(frames: DataFrame, clip: str, content: str, grid: list[tuple[float, float]], below: float = 12.0) -> DataFrame:
    """clip, k, dark, frames, failed: for each grid pixel whether it is dark in all readable frames of a clip, as padding is.

    The bits of a clip are folded by `and`, before and after the shuffle: a few numbers a frame, whatever the size of the images.
    """
    words = -(-len(grid) // 64)
    bits = dark_bits(frames, clip, content, grid, below)
    folded = bits.groupBy("clip").agg(F.array(*(F.bit_and(F.get("bits", F.lit(k))) for k in range(words))).alias("bits"), F.count("bits").alias("frames"), F.count("error").alias("failed"))
    each = folded.select("clip", "frames", "failed", "bits", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("k"))
    word = F.get("bits", F.floor(F.col("k") / 64).cast("int"))
    dark = F.coalesce(F.call_function("shiftrightunsigned", word, F.col("k") % 64).bitwiseAND(1) == 1, F.lit(False))
    return each.select("clip", F.col("k").cast("long").alias("k"), dark.alias("dark"), "frames", "failed")
