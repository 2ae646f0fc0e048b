"""Motion over even stretches of time, with the turns beside it, and what is said of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as num
from . import robust, windows

#: The words of a turn to either side, by the name of its angle.
TURNS = {"pan": ("turning right", "turning left"), "tilt": ("tilting up", "tilting down"), "roll": ("rolling clockwise", "rolling counter-clockwise"), "heading": ("turning to its right", "turning to its left")}


def even_samples(df: DataFrame, value: str, key: str, spans: DataFrame, segments: int = 10) -> DataFrame:
    """key, segment, at, value: the value at the segments + 1 even times of each key's span (key, a, b) that lie between frames where it is known, on the line between these."""
    w = windows._by(key)
    rows = df.where(F.col(value).isNotNull()).select(key, "frame", value).withColumns({"__next": F.lead("frame").over(w), "__then": F.lead(value).over(w)}).join(spans, key)
    step = (F.col("b") - F.col("a")) / segments
    low = F.greatest(F.ceil((F.col("frame") - F.col("a")) / step - 1e-9).cast("int"), F.lit(0))
    # up to the next frame, which samples its own time; the last frame samples its own time alone
    high = F.when(F.col("__next").isNull(), F.floor((F.col("frame") - F.col("a")) / step + 1e-9)).otherwise(F.ceil((F.col("__next") - F.col("a")) / step - 1e-9) - 1).cast("int")
    high = F.least(high, F.lit(segments))
    rows = rows.where((F.col("a") < F.col("b")) & (low <= high)).withColumn("segment", F.explode(F.sequence(low, high)))
    at = F.col("a") + F.col("segment") * step
    part = F.coalesce(F.try_divide(at - F.col("frame"), F.col("__next") - F.col("frame")), F.lit(0.0))
    return rows.select(key, F.col("segment").cast("long").alias("segment"), at.alias("at"), (F.col(value) + F.coalesce(part * (F.col("__then") - F.col(value)), F.lit(0.0))).alias(value))


def turns(df: DataFrame, angle: str, key: str, spans: DataFrame, least: float = 2.0) -> DataFrame:
    """key, <angle>_total, _noise, _from, _to: how far an angle went over a span, unwrapped; its scatter about its running mean; and the times over which it was measured.

    The noise is twice the scatter, but no less than `least`; a total needs two sampled times.
    """
    rows = windows.unwrapped(df.select(key, "frame", angle), angle, key, "__u")
    samples = even_samples(rows, "__u", key, spans).groupBy(key).agg(*(f("__u", "segment").alias(n) for n, f in (("__u0", F.min_by), ("__u1", F.max_by))), F.min("at").alias("__from"), F.max("at").alias("__to"), F.count("*").alias("__n"))
    mean = F.avg("__u").over(Window.partitionBy(key).orderBy("frame").rangeBetween(-2, 2))
    noise = robust.mad(rows.withColumn("__off", F.col("__u") - mean), "__off", key)
    two = F.col("__n") >= 2
    samples = samples.select(key, F.when(two, F.col("__u1") - F.col("__u0")).alias(f"{angle}_total"), F.when(two, F.col("__from")).alias(f"{angle}_from"), F.when(two, F.col("__to")).alias(f"{angle}_to"))
    return samples.join(noise.select(key, F.greatest(2 * F.col("sigma"), F.lit(least)).alias(f"{angle}_noise")), key, "full")


def turn_word(angle: str) -> Column:
    """What the turn was, 'no significant change' within its noise, 'unmeasured' without a total."""
    plus, minus = TURNS[angle]
    total, noise = F.col(f"{angle}_total"), F.coalesce(f"{angle}_noise", F.lit(0.0))
    return F.when(total.isNull(), "unmeasured").when(F.abs(total) <= noise, "no significant change").when(total > 0, plus).otherwise(minus)


def report(path: DataFrame, names: tuple[str, str, str], key: str, basis: DataFrame, floors: DataFrame, angles: dict[str, DataFrame]) -> DataFrame:
    """A row for each key with two frames or more and a basis: net components and size, path, floor, above, breakdown, runs, a and b (the span), and the turns of each angle.

    path: (key, frame, names), smooth; basis: (key, b0, b1, b2), the axes right, down and forward; floors: (key, floor); angles: (key, frame, name) by name.
    """
    spans = path.groupBy(key).agg(F.min("frame").cast("double").alias("a"), F.max("frame").cast("double").alias("b")).where("a < b")
    samples = windows.uniform_segments(path, names, key)
    w = windows._by(key, "segment")
    steps = samples.select(key, "segment", *((F.lead(c).over(w) - F.col(c)).alias(f"d{k}") for k, c in enumerate(names))).where("d0 is not null").join(basis, key)
    own = tuple(num.dot(tuple(F.col(f"d{k}") for k in range(3)), tuple(F.get(f"b{i}", F.lit(k)) for k in range(3))) for i in range(3))
    steps = steps.select(key, F.col("segment").alias("frame"), *(v.alias(n) for v, n in zip(own, ("right", "down", "forward"))))
    vector = tuple(F.col(n) for n in ("right", "down", "forward"))
    steps = steps.withColumns({"word": num.direction(vector), "distance": num.norm(vector)})
    runs = windows.run_lengths(steps, "word", key, "distance")
    told = F.concat(F.col("word"), F.lit(" for "), F.format_string("%.3f", F.round("sum_distance", 3)), F.lit(" units"), F.when(F.col("n") > 1, F.concat(F.lit(" across "), F.col("n").cast("string"), F.lit(" segments"))).otherwise(""))
    # at most ten runs a key
    runs = runs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", told.alias("told")))), lambda r: r["told"]), "; then ").alias("runs"))
    net = steps.groupBy(key).agg(*(F.sum(n).alias(n) for n in ("right", "down", "forward")), F.sum("distance").alias("path")).join(floors, key).join(runs, key).join(spans, key)
    net = net.withColumn("net", num.norm(vector))
    net = net.withColumns({"above": F.col("net") > F.col("floor"), "breakdown": num.ranked_components(vector)})
    for angle, rows in angles.items():
        net = net.join(turns(rows, angle, key, spans), key, "left")
    return net


def prose(prefix: Column | str, entity: str, angles: tuple[str, ...]) -> Column:
    """The report in words: first whether anything moved at all, then the runs, the net motion by axis, and each angle against its noise."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    number = lambda f, x: F.format_string(f, x)
    still = F.concat(prefix, F.lit(f", the {entity} is effectively STATIONARY: net displacement "), number("%.4f", F.col("net")), F.lit(" units is within the "), number("%.4f", F.col("floor")), F.lit("-unit noise floor, and the per-segment directions below are tracking jitter rather than measured motion."))
    moves = F.concat(
        prefix, F.lit(f", the {entity} moves "), F.col("runs"), F.lit(". Net displacement "), number("%.3f", F.col("net")), F.lit(" units, against a "), number("%.4f", F.col("floor")), F.lit("-unit noise floor. Broken down by axis, largest first: "), F.col("breakdown"), F.lit("."),
    )
    clauses = []
    for a in angles:
        total, noise, word = F.col(f"{a}_total"), F.coalesce(f"{a}_noise", F.lit(0.0)), turn_word(a)
        degrees = F.concat(F.lit(f"{a} "), number("%+.1f", total), F.lit(" deg ("))
        clause = F.concat(degrees, F.when(word == "no significant change", F.concat(F.lit("within the +/-"), number("%.1f", noise), F.lit(" deg noise floor"))).otherwise(word), F.lit(")"))
        part = (F.col(f"{a}_from") > F.col("a") + 0.5) | (F.col(f"{a}_to") < F.col("b") - 0.5)
        only = F.concat(F.lit(" -- measured only over frames "), number("%.0f", F.col(f"{a}_from")), F.lit("-"), number("%.0f", F.col(f"{a}_to")), F.lit(", NOT the whole clip"))
        clauses.append(F.when(total.isNull(), F.lit(f"{a} unmeasured")).otherwise(F.concat(clause, F.when(part, only).otherwise(""))))
    return F.concat(F.when(F.col("above"), moves).otherwise(still), F.lit(f" Over the same span, {entity} orientation changed: "), F.concat_ws("; ", *clauses), F.lit("."))


def unavailable(bucket: str, reason: Column) -> Column:
    """A report that could not be made, so that its reader can act on it."""
    return F.concat(F.lit(f"The {bucket} measurement is UNAVAILABLE for this clip: "), reason, F.lit(". No substitute measurement was made. Answer from the video frames alone, say so in your reasoning, and choose an option expressing uncertainty if one is offered."))
