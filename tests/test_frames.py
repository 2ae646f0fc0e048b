"""Masks, nearest points, stored images and sequential draws against brute force."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.functions import masks
from marlspan.operators import nearest, sampling
from marlspan.sources import images


def test_mask_matches(spark):
    rng = np.random.default_rng(1)
    rows, refs, expected = [], [], {}
    for frame in range(12):
        shape = (9, 15) if frame % 3 else (1, 64)
        ref = rng.random(shape) < 0.4 if frame != 4 else np.zeros(shape, bool)
        refs.append((frame, *shape, ref.ravel().tolist()))
        best = (None, None)
        for who in range(5):
            mask = rng.random(shape) < 0.4 if who % 2 and frame != 4 else ref & False if frame == 4 else np.roll(ref, who // 2)
            size = shape if who != 3 else shape[::-1]
            rows.append((frame, who, *size, mask.ravel().tolist()))
            union = (mask | ref).sum()
            if size == shape and union:
                iou = (mask & ref).sum() / union
                if best[1] is None or iou > best[1]:
                    best = (who, iou)
        expected[frame] = best
    pack = lambda df: df.withColumn("mask", masks.packed("flags")).drop("flags")
    m = pack(spark.createDataFrame(rows, "frame long, who long, height int, width int, flags array<boolean>"))
    r = pack(spark.createDataFrame([*refs, (99, 2, 2, [True] * 4)], "frame long, height int, width int, flags array<boolean>"))
    found = {x.frame: x for x in masks.best_matches(m, r, ["frame"], "who").collect()}
    assert found.keys() == expected.keys() | {99}
    for frame, (who, iou) in expected.items():
        assert found[frame].matched == who and (iou is None or abs(found[frame].iou - iou) < 1e-12) and found[frame].status == ("ok" if who is not None else "no object overlaps")
    assert found[99].matched is None
    areas = spark.createDataFrame(refs, "frame long, height int, width int, flags array<boolean>").select("flags", masks.area(masks.packed("flags")).alias("n")).collect()
    assert [a.n for a in areas] == [sum(a.flags) for a in areas]


def brute_nearest(askers, points):
    out = {}
    for frame, a, label, *p in askers:
        if None in p:
            continue
        near = [(round(sum((x - y) ** 2 for x, y in zip(p, q)), 9), other) for f, other, *q in points if f == frame and other != label and None not in q]
        if near:
            out[a] = min(near)[1]
    return out


def test_nearest_points(spark):
    rng = random.Random(3)
    points, askers = [], []
    for frame in range(4):
        for k in range(150):
            spread = (1, 1000, 1e-3, 0)[frame]  # the last frame: all points at one place
            p = [round(rng.gauss(0, spread) + (50 if k % 10 == 0 else 0) * spread, 3 if frame < 2 else 6) for _ in range(3)]
            points.append((frame, 1000 * frame + k, *p))
            askers.append((frame, 1000 * frame + k, 1000 * frame + (k if k % 3 else k + 1), *p))
    points += [(0, 5, None, 0.0, 0.0), (7, 7000, 1.0, 1.0, 1.0), (8, 8000, 0.0, 0.0, 0.0), (8, 8001, 0.0, 0.0, 0.0)]
    askers += [(7, 7000, 7000, 1.0, 1.0, 1.0), (8, 8000, 8000, 0.0, 0.0, 0.0), (9, 9000, 0, 0.0, 0.0, 0.0), (0, 9001, 0, None, 0.0, 0.0), (1, 9002, 0, 1e6, 1e6, 1e6)]
    a = spark.createDataFrame([(f, (k, label), *p) for f, k, label, *p in askers], "frame long, asker struct<k:long,label:long>, x double, y double, z double")
    b = spark.createDataFrame(points, "frame long, track long, x double, y double, z double")
    found = nearest.nearest(a, b, ["frame"], ("x", "y", "z"), "asker", "track", F.col("asker.label") != F.col("p_track"))
    assert {r.asker.k: r.nearest for r in found.collect()} == brute_nearest(askers, points)


def test_rows_met_are_linear(spark):
    """A frame of 20,000 points and one of 40,000: twice the rows, not four times."""
    met = []
    for n in (20_000, 40_000):
        df = spark.range(n).select(F.lit(0).alias("frame"), "id", F.rand(1).alias("x"), F.rand(2).alias("y"))
        rounds: list[int] = []
        found = nearest.nearest(df.withColumnRenamed("id", "asker"), df.withColumnRenamed("id", "track"), ["frame"], ("x", "y"), "asker", "track", F.col("asker") != F.col("p_track"), rounds)
        assert found.count() == n
        met.append(sum(rounds))
    assert met[1] < 3 * met[0] and met[1] < 200 * 40_000


def png(pixels, colour, depth=8, filters=None, palette=None):
    """A file with each line's filter chosen: the encoder's side of what is tested."""
    height, width = pixels.shape[:2]
    flat = pixels.reshape(height, -1)
    step = max(1, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour] * depth // 8)
    if depth == 16:
        flat = flat.astype(">u2").view(np.uint8).reshape(height, -1)
    elif depth < 8:
        flat = np.packbits(np.unpackbits(flat[:, :, None].astype(np.uint8), axis=2)[:, :, 8 - depth :].reshape(height, -1), axis=1)
    flat = flat.astype(np.int64)
    raw, above = b"", np.zeros(flat.shape[1], np.int64)
    for y in range(height):
        left = np.concatenate([np.zeros(step, np.int64), flat[y][:-step]]) if flat.shape[1] > step else np.zeros(flat.shape[1], np.int64)
        corner = np.concatenate([np.zeros(step, np.int64), above[:-step]]) if flat.shape[1] > step else np.zeros(flat.shape[1], np.int64)
        p = left + above - corner
        da, db, dc = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * left, left, above, (left + above) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, above, corner))]
        kind = (filters or [y % 5])[y % len(filters or [0])]
        raw += bytes([kind]) + ((flat[y] - guess[kind]) % 256).astype(np.uint8).tobytes()
        above = flat[y]
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = zlib.compress(raw)
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", data[:20]) + chunk(b"IDAT", data[20:]) + chunk(b"IEND", b"")


def grey_of(rgb):
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return (19595 * r + 38470 * g + 7471 * b + 0x8000) >> 16


@pytest.mark.parametrize("filters", [None, [0], [1], [2], [3], [4]])
def test_images(filters):
    rng = np.random.default_rng(2)
    for height, width in ((1, 1), (7, 5), (16, 33)):
        of = lambda *shape: rng.integers(0, 256, (height, width, *shape), dtype=np.uint8)
        grey, rgb, both, rgba = of(), of(3), of(2), of(4)
        assert np.array_equal(images.luma(png(grey, 0, filters=filters)), grey)
        assert np.array_equal(images.luma(png(rgb, 2, filters=filters)), grey_of(rgb))
        assert np.array_equal(images.luma(png(both, 4, filters=filters)), both[..., 0])
        assert np.array_equal(images.luma(png(rgba, 6, filters=filters)), grey_of(rgba))
        palette = rng.integers(0, 256, (16, 3), dtype=np.uint8)
        for depth in (4, 8):
            assert np.array_equal(images.luma(png(grey % 16, 3, depth, filters, palette)), grey_of(palette[grey % 16]))
        for depth in (1, 2, 4):
            assert np.array_equal(images.luma(png(grey % (1 << depth), 0, depth, filters)), (grey % (1 << depth)) * (255 // ((1 << depth) - 1)))
        assert np.array_equal(images.luma(png(grey.astype(np.uint16) * 256 + 7, 0, 16, filters)), grey)
        assert np.array_equal(images.luma(images.encoded(grey)), grey)


def test_dark_borders(spark):
    """Frames with bars above and below, one clip without, one with an unreadable frame, one with nothing else."""
    rng = np.random.default_rng(3)
    rows = []
    for clip in ("bars", "none"):
        for _ in range(6):
            image = rng.integers(12, 256, (40, 60), dtype=np.uint8)
            if clip == "bars":
                image[:8] = rng.integers(0, 12, (8, 60))
                image[33:] = 0
            image[20, 30] = 3 if len(rows) % 2 else 200  # dark in some frames only
            rows.append((clip, images.encoded(image)))
    rows += [("bars", b"no image"), ("bars", rows[0][1][:-30]), ("bad", None)]
    grid = [(6.4 * i, 4.2 * j) for i in range(10) for j in range(10)] + [(30.0, 20.0)]
    found = images.dark_in_all_frames(spark.createDataFrame(rows, "clip string, content binary").repartition(4), "clip", "content", grid).collect()
    assert {(r.clip, r.frames, r.failed) for r in found} == {("bars", 6, 2), ("none", 6, 0), ("bad", 0, 1)} and len(found) == 3 * len(grid)
    for r in found:
        v = round(grid[r.k][1])
        assert r.dark == (r.clip == "bars" and (v < 8 or v >= 33)), r


def plain_draw(rows, quotas, repeats):
    """rows: (task, cell, video, place, key)."""
    out = []
    for task in sorted({r[0] for r in rows}):
        used = set()
        for cell, n in quotas.items():
            pool = sorted((r for r in rows if r[0] == task and r[1] == cell), key=lambda r: (r[3], r[4]))
            chosen = []
            for r in pool:
                if len(chosen) < n and r[2] not in used:
                    used.add(r[2])
                    chosen.append((r[4], 0))
            if repeats:
                taken = {k for k, _ in chosen}
                chosen += [(r[4], 1) for r in pool if r[4] not in taken][: n - len(chosen)]
            out += chosen
    return sorted(out)


@pytest.mark.parametrize("repeats", [False, True])
def test_draws_as_one_after_another(spark, repeats):
    rng = random.Random(6)
    rows = [(rng.randint(0, 2), rng.choice("abcde"), rng.randint(0, 25) or None, rng.randint(0, 9), k) for k in range(400)]
    quotas = {"c": 9, "a": 1, "e": 0, "b": 12, "absent": 2}
    df = spark.createDataFrame(rows, "task int, cell string, video long, place int, k long").repartition(4)
    drawn = sampling.distinct_draw(df, "cell", quotas, "video", ["place"], "k", "task", repeats)
    assert sorted((r.k, r.turn) for r in drawn.collect()) == plain_draw(rows, quotas, repeats)


def test_cells_that_lack_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "k long, cell string, video string")
    assert {(r.k, r.cell) for r in sampling.cell_rows(df, "cell", ["a", "b"], "video", 1, "k").collect()} == {(1, "a"), (3, "b")}
    with pytest.raises(sampling.Short, match="c: 0 of 1"):
        sampling.cell_rows(df, "cell", ["a", "b", "c"], "video", 1, "k")
    with pytest.raises(sampling.Short, match="a: 1 of 2"):
        sampling.quota(df, "cell", 2, 1, "k", strict=True)
    assert sampling.quota(df, "cell", 1, 1, "k", strict=True).count() == 2
