"""Exact nearest points within frames, by grids whose cells double until the bound holds."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Cells of the finest grid along the longest side of a frame, as a power of two.
LEVELS = 14


def _cell(names: tuple[str, ...], level: Column) -> list[Column]:
    """Where a point lies in the grid of a level; level 0 has one cell."""
    side = F.col("__extent") / F.pow(F.lit(2.0), level)
    return [F.when(side > 0, F.floor((F.col(c) - F.col(f"__low_{c}")) / side)).otherwise(0).cast("long") for c in names]


def nearest(askers: DataFrame, points: DataFrame, frame: list[str], xyz: tuple[str, ...], asker: str, point: str, allowed: Column, rows_met: list[int] | None = None) -> DataFrame:
    """asker, nearest, distance: of the points of an asker's frame that are allowed the nearest, the smallest `point` among equals; askers without one have no row.

    askers: (frame, asker, coordinates); points: (frame, point, coordinates), prefixed by p_ in `allowed`.  Points without coordinates are not met.

    A frame's first grid is the coarsest in which a point meets eight others on average, by counts of the cells at all levels in one pass.  An asker meets the points of
    its own and the neighbouring cells; if the nearest of these is within the side of a cell, none outside can be nearer.  The others go on in cells of twice the
    side, which are met by fewer and fewer.  rows_met, if given, gets the number of pairs of each round.
    """
    known = F.lit(True)
    for c in xyz:
        known = known & F.col(c).isNotNull() & ~F.isnan(c)
    askers, points = askers.select(*frame, asker, *xyz).where(known), points.select(*frame, point, *xyz).where(known)
    both = points.select(*frame, *xyz).unionByName(askers.select(*frame, *xyz)).groupBy(*frame)
    box = both.agg(F.greatest(*(F.max(c) - F.min(c) for c in xyz), F.lit(0.0)).alias("__extent"), *(F.min(c).alias(f"__low_{c}") for c in xyz))
    # what a point of a frame meets in its cell, on average, at each level: the sum of squares of the cells' counts by the number of points
    levels = points.join(box, frame).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    counts = levels.groupBy(*frame, "level", *(v.alias(f"__c{k}") for k, v in enumerate(_cell(xyz, F.col("level"))))).agg(F.count("*").alias("n"))
    met = counts.groupBy(*frame, "level").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("met"))
    start = met.groupBy(*frame).agg(F.coalesce(F.min(F.when(F.col("met") <= 8, F.col("level"))), F.lit(LEVELS)).alias("__level"))
    frames = cut(box.join(start, frame))
    points = cut(points.join(frames, frame).select(*frame, "__extent", "__level", *(f"__low_{c}" for c in xyz), point, *xyz))
    active = cut(askers.join(frames, frame).select(*frame, "__extent", "__level", *(f"__low_{c}" for c in xyz), asker, *xyz))
    cells = [f"__c{k}" for k in range(len(xyz))]
    done: list[DataFrame] = []
    offsets = F.array(*(F.struct(*(F.lit(d).alias(f"d{k}") for k, d in enumerate(o))) for o in product((-1, 0, 1), repeat=len(xyz))))
    for up in range(LEVELS + 1):
        level = F.greatest(F.col("__level") - up, F.lit(0))
        at = lambda df: df.select("*", *(v.alias(c) for c, v in zip(cells, _cell(xyz, level))))  # noqa: B023, E731
        around = at(active).withColumn("__o", F.explode(offsets)).withColumns({c: F.col(c) + F.col(f"__o.d{k}") for k, c in enumerate(cells)})
        other = at(points).select(*frame, *cells, F.col(point).alias(f"p_{point}"), *(F.col(c).alias(f"p_{c}") for c in xyz))
        pairs = around.join(other, [*frame, *cells]).where(allowed)
        if rows_met is not None:
            rows_met.append(pairs.count())
        square = F.round(sum(((F.col(c) - F.col(f"p_{c}")) ** 2 for c in xyz), F.lit(0.0)), 9)
        best = pairs.groupBy(asker).agg(F.min(F.struct(square.alias("square"), F.col(f"p_{point}").alias("point"))).alias("__best"))
        side = F.col("__extent") / F.pow(F.lit(2.0), level)
        found = cut(active.join(best, asker, "left").withColumn("__settled", F.coalesce(F.sqrt("__best.square") <= side * (1 - 1e-9), F.lit(False)) | (level == 0)))
        done.append(found.where("__settled and __best is not null").select(asker, F.col("__best.point").alias("nearest"), F.sqrt("__best.square").alias("distance")))
        active = found.where("not __settled").drop("__best", "__settled")
        if active.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
