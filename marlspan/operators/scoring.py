"""Scoring runs: cubes, denominators, confusion, flips, coverage, post-stratified estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 6)


def score_cube(df: DataFrame, prediction: str, truth: str, *dimensions: str) -> DataFrame:
    """One pass over grouping sets: all rows, and each dimension by itself.

    A prediction is a choice, 'UNMAPPABLE' or 'NO_ANSWER'.
    """
    sets = ", ".join(["()", *(f"({d})" for d in dimensions)])
    mapped = f"count_if({prediction} not in ('UNMAPPABLE', 'NO_ANSWER'))"
    correct = f"count_if({prediction} = {truth})"
    grouping = ", ".join(f"case when grouping({d}) = 0 then cast({d} as string) end" for d in dimensions)
    return df.sparkSession.sql(
        f"""select coalesce({', '.join(f"case when grouping({d}) = 0 then '{d}' end" for d in dimensions)}, 'all') as dimension,
                   coalesce({grouping}, 'all') as member, count(*) as n, {mapped} as mapped,
                   count_if({prediction} = 'UNMAPPABLE') as unmappable, count_if({prediction} = 'NO_ANSWER') as no_answer, {correct} as correct,
                   round(try_divide({correct}, count(*)), 6) as acc_all, round(try_divide({correct}, {mapped}), 6) as acc_mapped,
                   round(try_divide({mapped}, count(*)), 6) as map_rate
            from {{df}} group by grouping sets ({sets})""",
        df=df,
    )


def accuracy_denominators(df: DataFrame, correct: Column, parsed: Column, completed: Column) -> DataFrame:
    """Accuracy over all rows, over parsed and over completed ones: what is not parsed is not correct."""
    right = F.count_if(correct & parsed)
    return df.agg(
        F.count("*").alias("n"), F.count_if(parsed).alias("parsed"), F.count_if(completed).alias("completed"), right.alias("correct"),
        share(right, F.count("*")).alias("acc_all"), share(right, F.count_if(parsed)).alias("acc_parsed"), share(F.count_if(correct & parsed & completed), F.count_if(completed)).alias("acc_completed"),
    )


def answer_flips(df: DataFrame, before: dict[str, str], after: str, truth: str) -> DataFrame:
    """By reference run: gains, losses and wrong answers that changed; nulls are answers that differ from all letters."""
    stack = ", ".join(f"'{name}', {column}" for name, column in before.items())
    rows = df.selectExpr(f"stack({len(before)}, {stack}) as (run, before)", f"{after} as after", f"{truth} as truth")
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    kind = F.when(~changed, "same").when(F.col("after").eqNullSafe(F.col("truth")), "gain").when(F.col("before").eqNullSafe(F.col("truth")), "loss").otherwise("changed_wrong")
    return rows.groupBy("run", kind.alias("flip")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, expected: str, chosen: str) -> DataFrame:
    """Cells of the matrix with the agreement over all rows."""
    cells = df.groupBy(expected, chosen).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()
    agree = F.sum(F.when(F.col(expected) == F.col(chosen), F.col("n")).otherwise(0)).over(whole)
    return cells.withColumn("agreement", share(agree, F.sum("n").over(whole)))


def zero_filled(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Counts of every known member, those without rows too, with shares of all rows."""
    counts = facts.groupBy(key).agg(F.count("*").alias("n"))
    out = dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("share", share(100 * F.col("n"), F.sum("n").over(Window.partitionBy())))


def crosstab(df: DataFrame, row: str, cell: str) -> DataFrame:
    """Per row the non-empty cells as text, most frequent first, then by name."""
    cells = df.groupBy(row, cell).agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(cell).cast("string").alias("c"))))
    return cells.groupBy(row).agg(F.array_join(F.transform(ordered, lambda s: F.concat(s["c"], F.lit(":"), (-s["k"]).cast("string"))), ",").alias("cells"))


def top_modes(df: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), value)).cast("long")
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def post_stratified(population: DataFrame, sample: DataFrame, strata: list[str], label: str) -> DataFrame:
    """Estimated rows of each label: every covered stratum's population times the label's share of its sample."""
    sizes = population.groupBy(*strata).agg(F.count("*").alias("population"))
    drawn = sample.groupBy(*strata).agg(F.count("*").alias("drawn"))
    cells = sample.groupBy(*strata, label).agg(F.count("*").alias("n"))
    rows = cells.join(drawn, strata).join(sizes, strata)
    return rows.groupBy(label).agg(F.round(F.sum(F.col("population") * F.col("n") / F.col("drawn")), 6).alias("estimate"))


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, named missing or extra."""
    a, b = expected.select(key).distinct().withColumn("__a", F.lit(1)), found.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full_outer").where("__a is null or __b is null").select(key, F.when(F.col("__b").isNull(), "missing").otherwise("extra").alias("problem"))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
