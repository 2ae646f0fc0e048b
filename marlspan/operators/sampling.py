"""Deterministic sampling: the order of a keyed digest stands for a random draw."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def hash_order(seed: int | Column, *keys: str) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def uniform(df: DataFrame, size: int, seed: int, *keys: str) -> DataFrame:
    """`size` rows without replacement: the first by digest (a top-k, not a sort)."""
    return df.withColumn("__h", hash_order(seed, *keys)).orderBy("__h", *keys).limit(size).drop("__h")


class Short(ValueError):
    """Strata with fewer rows than they were to give."""


def _none_short(drawn: DataFrame, stratum: str, quotas: dict[str, int]) -> DataFrame:
    """The drawn rows, if each stratum has its number; the counts are one row a stratum."""
    found = {r[0]: r[1] for r in drawn.groupBy(F.col(stratum).cast("string")).count().collect()}
    short = {s: found.get(s, 0) for s, n in quotas.items() if found.get(s, 0) < n}
    if short:
        raise Short(", ".join(f"{s}: {n} of {quotas[s]}" for s, n in short.items()))
    return drawn


def quota(df: DataFrame, stratum: str, size: int, seed: int, key: str, distinct: str | None = None, strict: bool = False) -> DataFrame:
    """`size` rows of each stratum; with `distinct`, one row for each of its values first; strict: a stratum that has fewer is an error."""
    rows = df.withColumn("__h", hash_order(seed, key))
    if distinct:
        first = F.row_number().over(Window.partitionBy(stratum, distinct).orderBy("__h", key))
        rows = rows.withColumn("__f", first).where("__f = 1").drop("__f")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    drawn = rows.withColumn("__r", rank).where(F.col("__r") <= size).drop("__r", "__h")
    if strict:
        _none_short(drawn, stratum, {r[0]: size for r in df.select(F.col(stratum).cast("string")).distinct().collect()})
    return drawn


def distinct_draw(df: DataFrame, cell: str, quotas: dict[str, int], video: str, place: list[str | Column], key: str, group: str | None = None, repeats: bool = False) -> DataFrame:
    """The cells' rows, cell by cell in the order of `quotas`: each takes its first rows by place whose video neither it nor an earlier cell has taken.

    Cells of different groups share their videos.  repeats: a cell that stays short then takes its first other rows, whatever their videos.
    turn: 0 for the first kind, 1 for the second.  Keys are unique.

    Earlier cells can take as many videos as their quotas allow, so of each cell's videos the first sum of all quotas decide what it draws:
    these are ranked where they lie, and only they are looked at one after another, in a task for each group.
    """
    columns = [cell, video, key] + ([group] if group else [])
    rows = df.where(F.col(cell).cast("string").isin(*quotas)).select(*columns, F.struct(*place, F.col(key)).alias("__place"))
    at = [cell] + ([group] if group else [])
    best = rows.groupBy(*at, video).agg(F.min("__place").alias("__place"))
    rank = F.row_number().over(Window.partitionBy(*at).orderBy("__place"))
    few = best.withColumn("__rank", rank).where(F.col("__rank") <= sum(quotas.values()))
    few = few.select(F.col(cell).cast("string").alias("cell"), F.col(group).cast("string").alias("group") if group else F.lit("").alias("group"), F.col(video).cast("string").alias("video"), F.col(f"__place.{key}").alias("key"), "__rank")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        by_cell = dict(tuple(part.sort_values("__rank").groupby("cell")))
        for name, n in quotas.items():
            for video_of, key_of in by_cell[name][["video", "key"]].itertuples(index=False, name=None) if name in by_cell else ():
                if n and video_of not in taken:
                    taken.add(video_of)
                    out.append(key_of)
                    n -= 1
        return pd.DataFrame({"key": out})

    kind = df.schema[key].dataType.simpleString()
    chosen = few.groupBy("group").applyInPandas(choose, f"key {kind}").select(F.col("key").alias(key), F.lit(0).alias("turn"))
    drawn = df.join(chosen, key)
    if not repeats:
        return drawn
    wanted = F.create_map(*(F.lit(x) for item in quotas.items() for x in item))
    have = drawn.groupBy(*at).agg(F.count("*").alias("__have"))
    rest = df.where(F.col(cell).cast("string").isin(*quotas)).join(chosen.select(key), key, "left_anti").join(have, at, "left")
    rest = rest.withColumn("__missing", wanted[F.col(cell).cast("string")] - F.coalesce("__have", F.lit(0))).where("__missing > 0")
    again = F.row_number().over(Window.partitionBy(*at).orderBy(*place, key))
    rest = rest.withColumn("__again", again).where("__again <= __missing").drop("__again", "__missing", "__have").withColumn("turn", F.lit(1))
    return drawn.unionByName(rest)


def rare_first(df: DataFrame, stratum: str, rare: Column, quotas: dict[str, int], seed: int, key: str, video: str, group: str | None = None, reserve: float = 0.2) -> DataFrame:
    """Per stratum: max(1, reserve x quota) rare rows first, then the others, then what is left of the rare ones, each by digest; distinct videos, repeats only where these do not suffice."""
    places = F.create_map(*(F.lit(x) for s, n in quotas.items() for x in (s, max(1, int(reserve * n)))))[F.col(stratum).cast("string")]
    rows = df.withColumn("__h", hash_order(seed, key)).withColumn("__rare", F.coalesce(rare, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(*[stratum] + ([group] if group else []), "__rare").orderBy("__h", key))
    rows = rows.withColumn("__turn", F.when(~F.col("__rare"), 1).when(rank <= places, 0).otherwise(2))
    return distinct_draw(rows, stratum, quotas, video, ["__turn", "__h"], key, group, repeats=True).drop("__h", "__rare", "__turn")


def latin_cells(rows: DataFrame, name: str, columns: int = 6, run: int = 5) -> DataFrame:
    """The distinct values of a column in their order; value i holds the cells i .. i + run - 1, modulo the columns.

    The values are few: they are the rows of a design.
    """
    place = rows.select(name).distinct().withColumn("row", F.row_number().over(Window.orderBy(name)) - 1)
    return place.select(name, "row", F.explode(F.sequence(F.lit(0), F.lit(run - 1))).alias("k")).select(name, "row", F.pmod(F.col("row") + F.col("k"), F.lit(columns)).cast("long").alias("cate"))


def cell_rows(df: DataFrame, cell: str, cells: list[str], video: str, seed: int, key: str, strict: bool = True) -> DataFrame:
    """One row of each cell, in the order of the cells, the first by digest whose video no earlier cell has; a cell without any is an error, unless not strict."""
    ones = dict.fromkeys(cells, 1)
    drawn = distinct_draw(df.withColumn("__h", hash_order(seed, key)), cell, ones, video, ["__h"], key)
    return (_none_short(drawn, cell, ones) if strict else drawn).drop("__h", "turn")


def water_fill(available: DataFrame, name: str, amount: str, total: int) -> DataFrame:
    """Equal shares of the total, capped by what is there; what cannot be split goes by name.

    With strata by amount, the level is that of the first stratum that need not give all; then the
    rest is dealt out one by one among the open strata in the order of names.
    """
    by_amount = Window.orderBy(amount, name)
    rows = available.select(name, amount).withColumns({"__before": F.coalesce(F.sum(amount).over(by_amount.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__open": F.count("*").over(Window.partitionBy()) - F.row_number().over(by_amount) + 1})
    level = F.expr(f"({total} - __before) div __open")
    rows = rows.withColumn("__level", level).withColumn("__full", F.col(amount) <= F.col("__level"))
    whole = Window.partitionBy()
    # full strata come first by amount; the level is fixed by the first that is not
    cut = F.min(F.when(~F.col("__full"), F.struct(amount, name, "__level", "__before", "__open"))).over(whole)
    rows = rows.withColumn("__cut", cut)
    rank = F.row_number().over(Window.partitionBy(F.col("__full")).orderBy(name))
    left = F.lit(total) - F.col("__cut.__before") - F.col("__cut.__level") * F.col("__cut.__open")
    out = F.when(F.col("__full"), F.col(amount)).otherwise(F.col("__cut.__level") + F.when(rank <= left, 1).otherwise(0))
    return rows.select(name, out.cast("long").alias("quota"))


def balanced_seed(df: DataFrame, label: str, key: str, size: int, bounds: dict[str, tuple[int, int]], seeds: int = 500, step: int = 20) -> DataFrame:
    """The least of `seeds` seeds whose draw of `size` rows holds each label within its bounds, null if none does.

    Seeds are counted `step` at a time, and the scan stops at the first range that has one.
    """
    rows, found = df.select(key, label), None
    for first in range(0, seeds, step):
        draws = rows.withColumn("seed", F.explode(F.sequence(F.lit(first), F.lit(min(first + step, seeds) - 1))))
        draws = draws.withColumn("__h", hash_order(F.col("seed"), key))
        rank = F.row_number().over(Window.partitionBy("seed").orderBy("__h", key))
        counts = draws.withColumn("__r", rank).where(F.col("__r") <= size).groupBy("seed").agg(*(F.count_if(F.col(label) == x).alias(f"n_{k}") for k, x in enumerate(bounds)))
        good = F.lit(True)
        for k, (low, high) in enumerate(bounds.values()):
            good = good & F.col(f"n_{k}").between(low, high)
        found = counts.where(good).agg(F.min("seed")).first()[0]
        if found is not None:
            break
    return df.sparkSession.range(1).select(F.lit(found).cast("long").alias("seed"))


def ordered_index(df: DataFrame, first: str, *ties: str, out: str = "index", buckets: int = 64) -> DataFrame:
    """The rows with their place in the order of a column and then of the others, from 0.

    No task sees all rows: ranges of the whole order, not of its first column alone, are numbered each by itself, and the
    counts of the ranges before are added.  So rows that share a value are spread as others are.
    """
    rows = cut(df.repartitionByRange(buckets, first, *ties).withColumn("__bucket", F.spark_partition_id()))
    rows = rows.withColumn("__in", F.row_number().over(Window.partitionBy("__bucket").orderBy(first, *ties)))
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    counts = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(counts), "__bucket").withColumn(out, (F.col("__before") + F.col("__in") - 1).cast("long")).drop("__bucket", "__in", "__before")
