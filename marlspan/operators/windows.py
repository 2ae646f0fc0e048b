"""Ordered-frame operators: each works within a key, by one window sort of that key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.numeric import wrapped_difference


def framed(df: DataFrame, key: str, *order: str, name: str = "frame") -> DataFrame:
    """Rows numbered from 0 within the key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def spread(df: DataFrame, key: str, most: int = 250_000) -> DataFrame:
    """Rows brought together by key, in as many partitions as give each about `most` rows.

    For narrow rows that grow wide in their task: by the bytes of the shuffle, partitions would be made few and large.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))
    return df.repartition(parts, key)


def _by(key: str, order: str = "frame") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def filled(value: str, key: str, order: str = "frame") -> Column:
    """Nulls replaced on the line between the neighbours that have a value; constant at the ends."""
    v, at = F.col(value), F.when(F.col(value).isNotNull(), F.col(order))
    before = _by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    v0, t0 = F.last(v, True).over(before), F.last(at, True).over(before)
    # the next row with a value in one pass: a frame up to the end of the key would be read anew for every row
    following = f"ignore nulls over (partition by `{key}` order by `{order}`)"
    v1 = F.coalesce(v, F.expr(f"lead(`{value}`) {following}"))
    t1 = F.coalesce(at, F.expr(f"lead(if(`{value}` is not null, `{order}`, null)) {following}"))
    line = v0 + (v1 - v0) * F.try_divide(F.col(order) - t0, t1 - t0)
    return F.coalesce(v, line, v0, v1)


def running_mean(df: DataFrame, value: str, key: str, out: str, half: int = 2) -> DataFrame:
    """Centred mean over 2 half + 1 frames of the gap-filled signal; the window shrinks at the ends, gaps stay null."""
    df = df.withColumn("__filled", filled(value, key))
    mean = F.avg("__filled").over(_by(key).rowsBetween(-half, half))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), mean)).drop("__filled")


def running_mean_skipping(df: DataFrame, value: str, key: str, out: str, half: int = 2) -> DataFrame:
    """Centred mean of what is there, without filling."""
    return df.withColumn(out, F.avg(value).over(_by(key).rowsBetween(-half, half)))


#: Seven-point quadratic smoothing: centre weights over 21.
SAVGOL = (-2, 3, 6, 7, 6, 3, -2)


def savgol(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """Seven-point quadratic smoothing; the ends take the quadratic of their first or last seven frames.

    Gaps are filled on the line between their neighbours for it and are gaps afterwards; series with fewer than seven
    values stay as they are.
    """
    w, whole = _by(key), Window.partitionBy(key)
    df = df.withColumns({"__v": filled(value, key), "__n": F.count("*").over(whole), "__given": F.count(value).over(whole)})
    v, n = F.col("__v"), F.col("__n")
    centre = sum((c * F.lag(v, 3 - k).over(w) if k < 3 else c * (v if k == 3 else F.lead(v, k - 3).over(w)) for k, c in enumerate(SAVGOL)), F.lit(0.0)) / 21
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.nth_value(v, k + 1).over(all_) for k in range(7)]
    last = [F.first(F.when(F.col("frame") == n - 7 + k, v), True).over(all_) for k in range(7)]

    def quadratic(points: list[Column], x: Column) -> Column:
        # least squares over x = -3..3: sums of squares 28, of fourth powers 196
        s0 = sum(points[1:], points[0])
        s1 = sum(((k - 3) * p for k, p in enumerate(points)), F.lit(0.0))
        s2 = sum(((k - 3) ** 2 * p for k, p in enumerate(points)), F.lit(0.0))
        c = (7 * s2 - 28 * s0) / (7 * 196 - 28 * 28)
        return (s0 - 28 * c) / 7 + s1 / 28 * x + c * x * x

    x0, x1 = F.col("frame") - 3, F.col("frame") - (n - 7) - 3
    smooth = F.when(F.col("__given") < 7, F.col(value)).when(F.col("frame") < 3, quadratic(first, x0)).when(F.col("frame") >= n - 3, quadratic(last, x1)).otherwise(centre)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), smooth)).drop("__v", "__n", "__given")


def islands(df: DataFrame, flag: Column, key: str) -> DataFrame:
    """(key, start, end, frames) of each maximal run of frames with the flag."""
    rows = df.where(flag)
    rows = rows.withColumn("__run", F.col("frame") - F.row_number().over(_by(key)))
    return rows.groupBy(key, "__run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("frames")).drop("__run")


def run_lengths(df: DataFrame, word: str, key: str, *sums: str) -> DataFrame:
    """Neighbouring rows with the same word made one: its rows, sums, first and last frame."""
    changed = F.coalesce((F.lag(word).over(_by(key)) != F.col(word)).cast("int"), F.lit(1))
    rows = df.withColumn("__changed", changed)
    rows = rows.withColumn("run", F.sum("__changed").over(_by(key)).cast("long"))
    return rows.groupBy(key, "run", word).agg(F.count("*").alias("n"), *(F.sum(s).alias(f"sum_{s}") for s in sums), F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))


def path_length(df: DataFrame, step: Column, visible: Column, key: str) -> DataFrame:
    """Sum of the steps between neighbouring visible rows; a gap breaks the chain."""
    both = visible & F.coalesce(F.lag(visible).over(_by(key)), F.lit(False))
    rows = df.select(key, F.when(both, step).alias("__step"))
    return rows.groupBy(key).agg(F.coalesce(F.sum("__step"), F.lit(0.0)).alias("path_length"))


def unwrapped(df: DataFrame, angle: str, key: str, out: str) -> DataFrame:
    """Degrees without jumps over half a turn; null angles are passed over."""
    given = df.where(F.col(angle).isNotNull()).withColumn("__last", F.lag(angle).over(_by(key)))
    jump = F.col(angle) - F.col("__last")
    turn = wrapped_difference(F.col(angle), F.col("__last"))
    # a jump of exactly half a turn keeps its sign
    turn = F.when((turn == -180) & (jump > 0), F.lit(180.0)).otherwise(turn)
    given = given.withColumn("__step", F.coalesce(turn - jump, F.lit(0.0)))
    return given.withColumn(out, F.col(angle) + F.sum("__step").over(_by(key).rowsBetween(Window.unboundedPreceding, 0))).drop("__last", "__step")


def checkpoints(df: DataFrame, usable: Column, key: str) -> DataFrame:
    """(key, first, middle, last): the middle is the usable frame nearest the midpoint, the earlier of two; keys with fewer than two are left out."""
    rows = df.where(usable).select(key, "frame")
    span = rows.withColumns({"__a": F.min("frame").over(Window.partitionBy(key)), "__b": F.max("frame").over(Window.partitionBy(key))})
    off = F.abs(F.col("frame") - (F.col("__a") + F.col("__b")) / 2)
    return span.groupBy(key).agg(F.min("frame").alias("first_frame"), F.min_by("frame", F.struct(off, "frame")).alias("middle_frame"), F.max("frame").alias("last_frame")).where("first_frame < last_frame")


def lag_difference(df: DataFrame, values: tuple[str, ...], key: str, lag: int) -> DataFrame:
    """Displacement from the row `lag` frames before, as d_<value>."""
    return df.withColumns({f"d_{v}": F.col(v) - F.lag(v, lag).over(_by(key)) for v in values})


def second_difference(value: str, key: str) -> Column:
    w = _by(key)
    return F.abs(F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value))


def relative_to_first(value: str, key: str) -> Column:
    """Degrees from the first angle that is there."""
    first = F.first(value, True).over(_by(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return wrapped_difference(F.col(value), first)


def local_outlier(df: DataFrame, value: str, key: str, out: str, half: int = 2, ratio: float = 3.0) -> DataFrame:
    """Whether a value is `ratio` times more or less than the median of the positive ones around it."""
    near = F.percentile(F.when(F.col(value) > 0, F.col(value)), 0.5).over(_by(key).rowsBetween(-half, half))
    return df.withColumn(out, F.coalesce((F.col(value) > ratio * near) | (F.col(value) * ratio < near), F.lit(False)))


def uniform_segments(df: DataFrame, values: tuple[str, ...], key: str, segments: int = 10) -> DataFrame:
    """The values at segments + 1 even times between the first and last frame, on the line between the bracketing frames."""
    w = _by(key)
    ahead = {f"__next_{v}": F.lead(v).over(w) for v in (*values, "frame")}
    rows = df.withColumns(ahead)
    ends = {"__a": F.min("frame").over(Window.partitionBy(key)), "__b": F.max("frame").over(Window.partitionBy(key))}
    rows = rows.withColumns(ends).where("__a < __b")
    # the sample times that fall into [frame, next frame), and the last at the last frame
    step = (F.col("__b") - F.col("__a")) / segments
    low = F.ceil((F.col("frame") - F.col("__a")) / step - 1e-9).cast("int")
    high = F.when(F.col("__next_frame").isNull(), F.lit(segments)).otherwise((F.ceil((F.col("__next_frame") - F.col("__a")) / step - 1e-9) - 1).cast("int"))
    rows = rows.where(low <= high).withColumn("segment", F.explode(F.sequence(low, high)))
    at = F.col("__a") + F.col("segment") * step
    part = F.coalesce(F.try_divide(at - F.col("frame"), F.col("__next_frame") - F.col("frame")), F.lit(0.0))
    return rows.select(key, F.col("segment").cast("long").alias("segment"), at.alias("at"), *((F.col(v) + F.coalesce(part * (F.col(f"__next_{v}") - F.col(v)), F.lit(0.0))).alias(v) for v in values))
