"""Evidence behind answers: refusals of hopeless queries, diagnoses of nulls, rules on what an answer cites, scores against ground truth."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries without success before a refusal; seed and radius in pixels of the point policy.
MAX_BLIND, POINT_SEED, POINT_RADIUS = 3, 42, 12.0


def refusals(queries: DataFrame, key: str, call: str, targets: Column, visible: Column, proposed: Column) -> DataFrame:
    """(key, refused, failed, frames): whether the next query is refused.

    queries: the calls so far with their target frames and their visibility.  Three that saw nothing refuse any query,
    three that saw a part refuse one of at most two targets; `proposed` is the size of the proposed target list.
    """
    rows = queries.where(F.size(targets) == F.size(visible)).withColumns({
        "__blind": (F.size(visible) > 0) & ~F.exists(visible, lambda v: v), "__part": F.exists(visible, lambda v: v) & F.exists(visible, lambda v: ~v),
        "__gone": F.transform(F.filter(F.arrays_zip(targets.alias("f"), visible.alias("v")), lambda e: ~e["v"]), lambda e: e["f"]),
    })
    calls = lambda flag: F.array_sort(F.collect_list(F.when(F.col(flag), F.col(call))))
    out = rows.groupBy(key).agg(calls("__blind").alias("__b"), calls("__part").alias("__p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__gone")))).alias("__f"), F.max(proposed).alias("__n"))
    blind = F.size("__b") >= MAX_BLIND
    walking = (F.size("__p") >= MAX_BLIND) & (F.col("__n") <= 2)
    told = lambda c: F.when(blind | walking, c)
    return out.select(key, (blind | walking).alias("refused"), told(F.array_join(F.when(blind, F.col("__b")).otherwise(F.col("__p")), ",")).alias("failed"), told(F.array_join(F.transform("__f", lambda x: x.cast("string")), ",")).alias("frames"))


def null_bindings(bindings: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """(key, culprits): the variables that are bound to a null, each with its evidence and the frame of the place it points at.

    bindings: (key, variable, evidence_id, place); evidence: (key, evidence_id, frames, values), a value null where nothing was seen.
    """
    bound = bindings.join(evidence, [key, "evidence_id"])
    value = F.get("values", F.col("place"))
    frame = F.coalesce(F.get("frames", F.col("place")).cast("string"), F.lit("?"))
    bad = bound.where(value.isNull() & (F.col("place") < F.size("values"))).select(key, F.concat("variable", F.lit(" ("), "evidence_id", F.lit(", frame "), frame, F.lit(")")).alias("c"))
    return bad.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("c")), "; ").alias("culprits"))


def answer_verdict(kind: Column, task: Column, cited: Column, known: Column, targets: Column, computed: Column, value: Column, unit: Column) -> Column:
    """The first rule on evidence that a final answer breaks, or 'ok'.

    cited: ids; known: ids that exist; targets: frames of the cited queries; computed: finite numbers of the cited calculations.
    """
    span = F.sequence(F.array_min(targets), F.array_max(targets))
    holds = lambda prefix: F.exists(cited, lambda c: c.startswith(prefix))
    tolerance = F.greatest(F.lit(1e-3), 1e-3 * F.abs(value))
    metres = task.isin("endpoint_displacement", "distance_travelled") & ~F.lower(F.trim(unit)).isin("m", "meter", "meters", "metre", "metres")
    rules = [
        ("unknown_evidence", F.size(F.array_except(cited, known)) > 0), ("ok", kind == "text"), ("both_kinds_of_call", ~holds("d4rt_") | ~holds("math_")), ("two_frames", F.size(F.array_distinct(targets)) < 2),
        ("every_frame", (task == "distance_travelled") & (F.size(F.array_except(span, targets)) > 0)), ("no_such_result", ~F.exists(computed, lambda c: F.abs(value - c) <= tolerance)), ("metres", metres),
    ]
    return F.coalesce(*(F.when(bad, F.lit(code)) for code, bad in rules), F.lit("ok"))


def policy_points(box: tuple[Column, ...], width: int, height: int, ensemble: bool = True) -> Column:
    """The box's centre in pixels, then four points about it, drawn once for all boxes, clamped to the box and to the radius."""
    x0, x1 = (F.least(F.greatest(b * (max(width - 1, 1) / 1000.0), F.lit(0.0)), F.lit(float(width - 1))) for b in (box[0], box[2]))
    y0, y1 = (F.least(F.greatest(b * (max(height - 1, 1) / 1000.0), F.lit(0.0)), F.lit(float(height - 1))) for b in (box[1], box[3]))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    points = [F.struct(cx.alias("u"), cy.alias("v"))]
    for dx, dy in policy_offsets() if ensemble else ():
        u, v = (F.least(F.greatest(c + d, low), high) for c, d, low, high in ((cx, dx, x0, x1), (cy, dy, y0, y1)))
        off = F.hypot(u - cx, v - cy)
        shrink = F.when(off > POINT_RADIUS, POINT_RADIUS / off).otherwise(1.0)
        points.append(F.struct((cx + (u - cx) * shrink).alias("u"), (cy + (v - cy) * shrink).alias("v")))
    return F.array(*points)


def policy_offsets() -> list[tuple[float, float]]:
    rng = np.random.default_rng(POINT_SEED)
    angles, radii = rng.uniform(0.0, 2.0 * np.pi, size=4), POINT_RADIUS * np.sqrt(rng.uniform(0.0, 1.0, size=4))
    return [(float(r * np.cos(a)), float(r * np.sin(a))) for a, r in zip(angles, radii)]


def iou_status(iou: Column, found: Column) -> Column:
    return F.when(~found, "not_found").when(iou >= 0.75, "tight").when(iou >= 0.5, "loose").otherwise("missed")


def box_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """Median overlap and centre distance of the boxes that were found, and how many are over each bar. rows: found, iou, distance."""
    hit = lambda bar: F.count_if(F.col("found") & (F.col("iou") >= bar))
    seen = lambda c: F.median(F.when(F.col("found"), F.col(c)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("found").alias("n_found"), seen("iou").alias("iou"), hit(0.5).alias("half"), hit(0.75).alias("three_quarters"), seen("distance").alias("distance"))


def error_against(measured: Column, truth: Column) -> tuple[Column, Column]:
    """Absolute and relative error; none against a truth of nothing."""
    off = F.abs(measured - truth)
    return off, F.when(truth > 0, off / truth)
