"""Running measures over many rows: once for each distinct request, with errors kept to their row, through named stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_key(rows: DataFrame, key: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows with what `measure` adds to their distinct keys, and how many rows share it: a cache without a size or an eviction."""
    keys = rows.groupBy(key).agg(F.count("*").alias("uses"))
    return rows.join(measure(keys), key)


def contained(rows: DataFrame, columns: list[str], work: Callable, out: str, kind: str) -> DataFrame:
    """The rows with work(*columns) in `out`, or the name of what it raised in `error`: no row ends the run.

    For functions that have no columnar form (tried() is for those that have); rows go to Python in Arrow batches.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, {out} {kind}, error string"

    def run(batches):
        for b in batches:
            done, errors = [], []
            for values in b[columns].itertuples(index=False, name=None):
                try:
                    done.append(work(*values))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row's outcome
                    done.append(None)
                    errors.append(type(e).__name__)
            yield b.assign(**{out: pd.Series(done, index=b.index, dtype=object), "error": pd.Series(errors, index=b.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def tried(rows: DataFrame, out: str, value: Column, *failures: tuple[str, Column]) -> DataFrame:
    """The rows with a value in `out`, or the name of the first failure that holds in `error`: for work that has a columnar form.

    value: of functions that give null and no error, as try_divide and try_cast do.
    """
    error = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in failures), F.lit(None).cast("string"))
    return rows.withColumn("error", error).withColumn(out, F.when(F.col("error").isNull(), value))


@dataclass(frozen=True)
class Runners:
    """Stages by name, in order, each with the condition under which a target passes it."""

    stages: dict[str, Column]

    def run(self, targets: DataFrame) -> DataFrame:
        """stage: the one that a target failed, or the last; outcome: failed or done."""
        names = list(self.stages)
        failed = F.coalesce(*(F.when(~F.coalesce(good, F.lit(False)), F.lit(n)) for n, good in self.stages.items()))
        return targets.withColumns({"stage": F.coalesce(failed, F.lit(names[-1])), "outcome": F.when(failed.isNull(), "done").otherwise("failed")})

    def missing(self, wanted: list[str]) -> list[str]:
        """Names that are no stage."""
        return [n for n in wanted if n not in self.stages]
