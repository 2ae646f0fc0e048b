"""Segment reports against the same measures in numpy, and their words."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlspan.operators import segments
from marlspan.plans import reports


def plain_turn(frames, angles, a, b, least=2.0):
    """(total, noise, from, to) of one clip's angle."""
    known = [(f, x) for f, x in zip(frames, angles) if x is not None]
    if not known:
        return None, None, None, None
    at, values = np.array([f for f, _ in known], float), np.degrees(np.unwrap(np.radians([x for _, x in known])))
    off = values - np.array([values[np.abs(at - t) <= 2].mean() for t in at])
    noise = max(2 * 1.4826 * np.median(np.abs(off - np.median(off))), least)
    times = np.linspace(a, b, 11)
    times = times[(times >= at[0] - 1e-9) & (times <= at[-1] + 1e-9)]
    if len(times) < 2:
        return None, noise, None, None
    sampled = np.interp(times, at, values)
    return sampled[-1] - sampled[0], noise, times[0], times[-1]


def test_turns(spark):
    rng = np.random.default_rng(3)
    rows, spans, expected = [], [], {}
    for clip in range(12):
        n = (40, 32, 7, 2)[clip % 4]
        angles = [((float(x) + 180) % 360) - 180 for x in np.cumsum(rng.normal(0, 20, n))]
        if clip >= 4:
            angles = [None if rng.random() < 0.5 else x for x in angles]
        if clip == 9:
            angles = [None] * n
        a, b = (0.0, n - 1.0) if clip % 3 else (0.0, n + 5.0)
        rows += [(clip, f, x) for f, x in enumerate(angles)]
        spans.append((clip, a, b))
        expected[clip] = plain_turn(range(n), angles, a, b)
    found = segments.turns(spark.createDataFrame(rows, "k long, frame long, pan double"), "pan", "k", spark.createDataFrame(spans, "k long, a double, b double"))
    found = {r.k: r for r in found.collect()}
    for clip, values in expected.items():
        got = found.get(clip)
        got = (None,) * 4 if got is None else (got.pan_total, got.pan_noise, got.pan_from, got.pan_to)
        assert [x is None for x in got] == [x is None for x in values], clip
        assert all(x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got, values)), (clip, got, values)


@pytest.fixture(scope="module")
def camera(spark):
    """Four clips: a dolly to the right that pans, one that stands still, one with one usable frame, one that looks straight up."""
    rows = []
    for f in range(32):
        rows += [("dolly", f, 0.1 * f, 0.0, 0.02 * f, 0.0, True), ("still", f, 0.01 * (f * 7 % 5 - 2), 1.0, 1.0, 0.0, True), ("lost", f, 1.0, 1.0, float(f + 1), 0.0, f == 5), ("up", f, 0.0, -0.1 * (f + 1), 0.0, 2.0 * f, True)]
    ups = [("dolly", [0.0, -1.0, 0.0]), ("still", [0.0, -math.cos(math.radians(30)), -math.sin(math.radians(30))]), ("up", [0.0, 0.0, 1.0])]
    rows = spark.createDataFrame([(*r[:2], r[2] + 0.001, *r[3:]) for r in rows], "label string, frame long, cx double, cy double, cz double, turn double, usable boolean")
    return {r.label: r for r in reports.camera_motion(rows, spark.createDataFrame(ups, "label string, up array<double>")).collect()}


def test_a_camera_that_moves(camera):
    r = camera["dolly"]
    assert r.coordinate_frame == "observer-levelled" and abs(r.right - 2.9) < 0.02 and r.above
    assert r.text.startswith("In the observer's starting frame, with up/down measured against gravity, the camera moves right for ")
    assert "Broken down by axis, largest first: 2.900 right, 0.580 forward, 0.000 down." in r.text
    assert r.text.endswith("camera orientation changed: pan +0.0 deg (within the +/-2.0 deg noise floor); tilt +0.0 deg (within the +/-2.0 deg noise floor); roll +0.0 deg (within the +/-2.0 deg noise floor).")


def test_a_camera_that_stands_still(camera):
    r = camera["still"]
    assert not r.above and "the camera is effectively STATIONARY" in r.text and "The camera started pitched 30 degrees down" in r.text


def test_a_camera_without_frames(camera):
    r = camera["lost"]
    assert r.reason.startswith("camera pose recovery produced too few usable frames") and r.text.startswith("The traj_camera_own_frame measurement is UNAVAILABLE for this clip: camera pose") and r.coordinate_frame is None and r.net is None


def test_a_camera_without_a_level(camera):
    r = camera["up"]
    assert r.coordinate_frame == "observer" and r.text.startswith("In the observer's starting frame, the camera moves up for") and "NOTE: the world vertical could not be recovered" in r.text
    # turned about the vertical through 62 degrees: the axis points up, so the turn is to the left
    assert abs(abs(r.pan_total) - 62) < 0.5 and "turning" in r.text


def test_a_subject_without_a_front(spark):
    rows = reports.poses.poses(spark, "/root/testdata/sf0.001").withColumn("unique_front", F.lit(False))
    texts = reports.subject_motion(rows).collect()
    assert texts and all(r.text.startswith("The traj_subject_own_frame measurement is UNAVAILABLE") for r in texts)
