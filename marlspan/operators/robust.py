"""Robust statistics: natively where medians suffice, per group in numpy where an estimate is iterative."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scale of the median absolute deviation to a standard deviation.
MAD_SIGMA = 1.4826


def mad(df: DataFrame, value: Column | str, *keys: str) -> DataFrame:
    """(keys, center, sigma, n): median and scaled median absolute deviation; two passes over one grouping."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.alias("__v")).where("__v is not null")
    center = rows.groupBy(*keys).agg(F.median("__v").alias("center"))
    joined = rows.join(center, list(keys)) if keys else rows.crossJoin(F.broadcast(center))
    out = joined.groupBy(*keys, "center").agg((MAD_SIGMA * F.median(F.abs(F.col("__v") - F.col("center")))).alias("sigma"), F.count("*").alias("n"))
    return out


def few_quantiles(df: DataFrame, value: Column | str, probabilities: tuple[float, ...], key: str, accuracy: int = 10_000) -> DataFrame:
    """(key, q0, q1, ..., n): exact interpolated quantiles where keys are few and their rows are many.

    F.percentile holds every distinct value of a key in one buffer.  Here mergeable sketches of bounded size bracket each quantile
    first: its rank is off by n / accuracy at most, and the bracket is three times as wide on either side.  Then the rows below are
    counted, and only those within, a few in ten thousand, are put in order.  The brackets, one row a key, are broadcast.
    """
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(key, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    off = 3.0 / accuracy
    sketch = lambda sign: F.percentile_approx("__v", F.array(*(F.lit(min(1.0, max(0.0, p + sign * off))) for p in probabilities)), F.lit(accuracy))
    same = F.col(key).eqNullSafe(F.col("__k"))
    brackets = rows.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("n"), sketch(-1).alias("low"), sketch(1).alias("high"))
    # a key of fewer rows than tell the places apart is put in order whole
    wide = lambda c, end: F.when(F.col("n") < 4 * accuracy, F.array_repeat(F.lit(float(end)), len(probabilities))).otherwise(F.col(c)).alias(c)
    brackets = brackets.select("__k", "n", wide("low", "-inf"), wide("high", "inf"))
    met = rows.join(F.broadcast(brackets), same).drop("__k")
    at = range(len(probabilities))
    below = met.groupBy(F.col(key).alias("__k")).agg(F.first("n").alias("n"), *(F.count_if(F.col("__v") < F.col("low")[i]).alias(f"b{i}") for i in at))
    within = F.filter(F.array(*map(F.lit, at)), lambda i: F.col("__v").between(F.get("low", i), F.get("high", i)))
    inside = met.select(key, "__v", F.explode(within).alias("__i"))
    inside = inside.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__i").orderBy("__v")) - 1)
    joined = inside.join(F.broadcast(below), same)
    place = F.col("__r") + F.element_at(F.array(*(F.col(f"b{i}") for i in at)), F.col("__i") + 1)
    target = F.element_at(F.array(*map(F.lit, probabilities)), F.col("__i") + 1) * (F.col("n") - 1)
    # the two places about the target
    near = joined.select(key, "n", "__i", "__v", (place - F.floor(target)).alias("__d"), (target - F.floor(target)).alias("__part")).where("__d in (0, 1)")
    pick = lambda i, d: F.max(F.when((F.col("__i") == i) & (F.col("__d") == d), F.col("__v")))
    part = lambda i: F.max(F.when(F.col("__i") == i, F.col("__part")))
    line = lambda i: pick(i, 0) + F.coalesce((pick(i, 1) - pick(i, 0)) * part(i), F.lit(0.0))
    return near.groupBy(key).agg(*(line(i).alias(f"q{i}") for i in at), F.first("n").alias("n"))


def few_mad(df: DataFrame, value: str, key: str) -> DataFrame:
    """mad() by few_quantiles()."""
    center = few_quantiles(df, value, (0.5,), key).select(F.col(key).alias("__k"), F.col("q0").alias("center"))
    off = df.join(F.broadcast(center), F.col(key).eqNullSafe(F.col("__k")))
    spread = few_quantiles(off, F.abs(F.col(value) - F.col("center")), (0.5,), key)
    return spread.join(F.broadcast(center), F.col(key).eqNullSafe(F.col("__k"))).select(spread[key], "center", (MAD_SIGMA * F.col("q0")).alias("sigma"), "n")


def noise_floor(sigma: Column, *floors: Column | float) -> Column:
    """Twice the sigma, but none of the floors less."""
    return F.greatest(2 * F.coalesce(sigma, F.lit(0.0)), *(f if isinstance(f, Column) else F.lit(f) for f in floors))


def cloud_scale(df: DataFrame, xyz: tuple[str, str, str], *keys: str) -> DataFrame:
    """(keys, scale): median distance to the coordinate-wise median."""
    center = df.groupBy(*keys).agg(*(F.median(c).alias(f"__m{k}") for k, c in enumerate(xyz)))
    distance = F.sqrt(sum(((F.col(c) - F.col(f"__m{k}")) ** 2 for k, c in enumerate(xyz)), F.lit(0.0)))
    return df.join(center, list(keys)).groupBy(*keys).agg(F.median(distance).alias("scale"))


# ---- numpy kernels ----


def geometric_median(points: np.ndarray, weights: np.ndarray | None = None, rounds: int = 64, eps: float = 1e-9) -> np.ndarray:
    """Weighted point of least summed distance; under four points the coordinate-wise median."""
    if len(points) < 4:
        return np.median(points, axis=0)
    weights = np.ones(len(points)) if weights is None else weights
    center = np.median(points, axis=0)
    for _ in range(rounds):
        w = weights / np.maximum(np.linalg.norm(points - center, axis=1), eps)
        new = (w[:, None] * points).sum(0) / w.sum()
        if np.linalg.norm(new - center) < eps:
            return new
        center = new
    return center


def rigid_fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Rotation and translation that take a to b with least squares; None under three points."""
    if len(a) < 3:
        return None
    ca, cb = a.mean(0), b.mean(0)
    u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    r = vt.T @ flip @ u.T
    return r, cb - r @ ca


def ransac_rigid(a: np.ndarray, b: np.ndarray, rounds: int = 1000, ratio: float = 0.05, seed: int = 0):
    """(rotation, translation, rmse, inliers) of the largest consensus within ratio times b's scale, refitted; None if there is none."""
    n = len(a)
    if n < 3:
        return None
    scale = float(np.median(np.linalg.norm(b - np.median(b, axis=0), axis=1)))
    limit, rng = max(ratio * scale, 1e-9), np.random.default_rng(seed)
    best = np.zeros(n, bool)
    for _ in range(rounds):
        fit = rigid_fit(*(x[pick] for x, pick in zip((a, b), [rng.choice(n, 3, replace=False)] * 2)))
        good = np.linalg.norm(a @ fit[0].T + fit[1] - b, axis=1) < limit
        if good.sum() > best.sum():
            best = good
            if best.all():
                break
    if best.sum() < 3:
        return None
    r, t = rigid_fit(a[best], b[best])
    residual = np.linalg.norm(a[best] @ r.T + t - b[best], axis=1)
    return r, t, float(np.sqrt((residual**2).mean())), best


def plane_up(points: np.ndarray, rounds: int = 800, least: float = 0.15, most_tilt: float = 80.0, seed: int = 0):
    """(up, inlier share) of the dominant plane, pointing against +y; (None, share) if too few agree or it is too steep."""
    n = len(points)
    if n < 3:
        return None, 0.0
    rng = np.random.default_rng(seed)
    limit = 0.05 * max(float(np.median(np.linalg.norm(points - np.median(points, axis=0), axis=1))), 1e-9)
    best, normal = 0, None
    for _ in range(rounds):
        p = points[rng.choice(n, 3, replace=False)]
        v = np.cross(p[1] - p[0], p[2] - p[0])
        size = np.linalg.norm(v)
        if size < 1e-12:
            continue
        v = v / size
        good = int((np.abs((points - p[0]) @ v) < limit).sum())
        if good > best:
            best, normal = good, v
    share = best / n
    if normal is None or share < least:
        return None, share
    up = -normal if normal[1] > 0 else normal
    tilt = np.degrees(np.arccos(np.clip(-up[1], -1, 1)))
    return (None, share) if tilt > most_tilt else (up, share)


def farthest_points(points: np.ndarray, count: int) -> np.ndarray:
    """Indices: the point nearest the mean, then each time the one farthest from all chosen (the first of equals)."""
    if not len(points):
        return np.zeros(0, int)
    chosen = [int(np.linalg.norm(points - points.mean(0), axis=1).argmin())]
    distance = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < min(count, len(points)):
        k = int(distance.argmax())
        chosen.append(k)
        distance = np.minimum(distance, np.linalg.norm(points - points[k], axis=1))
    return np.array(chosen)


# ---- selection of whole tracks ----


def _distance(columns: tuple[str, ...], prefix: str) -> Column:
    return F.sqrt(sum(((F.col(c) - F.col(f"{prefix}{c}")) ** 2 for c in columns), F.lit(0.0)))


def select_tracks(points: DataFrame, xyz: tuple[str, ...], clip: str, track: str, membership: float = 3.0, motion: float = 2.0, lags: tuple[int, ...] = (4, 8, 16, 31), spread: float = 3.0) -> DataFrame:
    """(clip, track, radius, residual, jitter, reason): each track's measures and the first stage that drops it, or 'kept'.

    points: (clip, track, frame, x, y, z), null where not valid.  Membership: the median distance from the frame's centre
    against the cloud's scale.  Bulk motion: the median deviation from the common displacement, the worst of the
    lags, against the scale and against the tracks kept so far.  Smoothness: the median second difference against
    the tracks kept by then.  A track without a measure counts as beyond any limit; fewer than three tracks set no limit.
    """
    huge, keys = F.lit(1e308), [clip, track]
    scale = cloud_scale(points.where(F.col(xyz[0]).isNotNull()), xyz, clip)
    centre = points.groupBy(clip, "frame").agg(*(F.median(c).alias(f"m_{c}") for c in xyz))
    radius = points.join(centre, [clip, "frame"]).groupBy(*keys).agg(F.median(_distance(xyz, "m_")).alias("radius"))
    # Each point beside the one `lag` frames before, all lags in one join.
    shifted = points.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).select(clip, track, "lag", (F.col("frame") + F.col("lag")).alias("frame"), *(F.col(c).alias(f"p_{c}") for c in xyz))
    moved = points.join(shifted, [clip, track, "frame"]).select(clip, track, "lag", "frame", *((F.col(c) - F.col(f"p_{c}")).alias(c) for c in xyz))
    bulk = moved.groupBy(clip, "lag", "frame").agg(*(F.median(c).alias(f"m_{c}") for c in xyz))
    by_lag = moved.join(bulk, [clip, "lag", "frame"]).groupBy(*keys, "lag").agg(F.coalesce(F.median(_distance(xyz, "m_")), huge).alias("d"))
    residual = by_lag.groupBy(*keys).agg(F.max("d").alias("residual"))
    w = Window.partitionBy(*keys).orderBy("frame")
    second = F.sqrt(sum(((F.lead(c, 2).over(w) - 2 * F.lead(c, 1).over(w) + F.col(c)) ** 2 for c in xyz), F.lit(0.0)))
    jitter = points.select(*keys, second.alias("s")).groupBy(*keys).agg(F.coalesce(F.median("s"), huge).alias("jitter"))
    rows = radius.join(residual, keys, "left").join(jitter, keys).join(scale, clip).withColumn("residual", F.coalesce("residual", F.lit(0.0)))
    # Each stage's limits come from the tracks that are left.
    rows = rows.withColumn("keep", F.coalesce("radius", huge) <= membership * F.col("scale")).withColumn("reason", F.when(~F.col("keep"), "membership"))
    for measure, name, limit in (("residual", "bulk_motion", motion * F.col("scale")), ("jitter", "smoothness", None)):
        left = F.when(F.col("keep"), F.col(measure))
        all_ = Window.partitionBy(clip)
        rows = rows.withColumns({"n": F.count(left).over(all_), "centre": F.percentile(left, 0.5).over(all_)})
        rows = rows.withColumn("sigma", 1.4826 * F.percentile(F.when(F.col("keep"), F.abs(F.col(measure) - F.col("centre"))), 0.5).over(all_))
        bad = (F.col("n") > 2) & (F.col(measure) > F.col("centre") + spread * F.col("sigma"))
        bad = bad if limit is None else bad | (F.col(measure) > limit)
        rows = rows.withColumn("reason", F.when(F.col("keep") & F.coalesce(bad, F.lit(False)), name).otherwise(F.col("reason"))).withColumn("keep", F.col("reason").isNull())
    return rows.select(*keys, "radius", "residual", "jitter", F.coalesce("reason", F.lit("kept")).alias("reason"))


# ---- per group ----


def geometric_medians(df: DataFrame, xyz: list[str], key: str, weight: str | None = None) -> DataFrame:
    """key, x, y, z: the point of least summed distance of each key's points, weighted if a weight is named."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, z = geometric_median(pdf[xyz].to_numpy(float), None if weight is None else pdf[weight].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "x": [x], "y": [y], "z": [z]})

    return df.select(key, *xyz, *([weight] if weight else [])).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, x double, y double, z double")


def rigid_fits(df: DataFrame, source: list[str], target: list[str], key: str, order: str) -> DataFrame:
    """One robust fit per key: the matrix by rows, the translation, error and inliers; failed fits have null error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        fit = ransac_rigid(pdf[source].to_numpy(float), pdf[target].to_numpy(float))
        r, t, rmse, good = fit if fit else (np.full((3, 3), np.nan), np.full(3, np.nan), None, np.zeros(0))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "r": [r.ravel().tolist()], "t": [t.tolist()], "rmse": [rmse], "inliers": [int(good.sum())]})

    return df.select(key, order, *source, *target).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, r array<double>, t array<double>, rmse double, inliers long")


def pose_fits(df: DataFrame, source: list[str], target: list[str], keys: list[str], order: str, least: int = 4) -> DataFrame:
    """One robust fit per group of keys, as rigid_fits(); groups of fewer points than `least` are not tried."""
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        fit = ransac_rigid(pdf[source].to_numpy(float), pdf[target].to_numpy(float)) if len(pdf) >= least else None
        r, t, rmse, good = fit if fit else (np.full((3, 3), np.nan), np.full(3, np.nan), None, np.zeros(0))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "r": [r.ravel().tolist()], "t": [t.tolist()], "rmse": [rmse], "inliers": [int(good.sum())]})

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.select(*keys, order, *source, *target).groupBy(*keys).applyInPandas(run, f"{schema}, r array<double>, t array<double>, rmse double, inliers long")


def plane_ups(df: DataFrame, xyz: list[str], key: str, order: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up, share = plane_up(pdf.sort_values(order)[xyz].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "up": [None if up is None else up.tolist()], "share": [share]})

    return df.select(key, order, *xyz).groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, up array<double>, share double")


def farthest(df: DataFrame, xyz: list[str], key: str, order: str, count: int) -> DataFrame:
    kind = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order).reset_index(drop=True)
        at = farthest_points(pdf[xyz].to_numpy(float), count)
        return pd.DataFrame({key: pdf[key].iloc[at].to_numpy(), order: pdf[order].iloc[at].to_numpy(), "pick": np.arange(len(at))})

    return df.select(key, order, *xyz).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {order} {kind[order]}, pick long")
