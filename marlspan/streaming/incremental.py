"""Incremental runs: restartable by checkpoint, one state per question, late rows by watermark."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MOVES = {"": ("choose_bucket",), "choose_bucket": ("name_subject", "final_answer"), "name_subject": ("choose_candidate", "name_subject"), "choose_candidate": ("final_answer", "name_subject"), "final_answer": ()}


def pending(entries: DataFrame, outputs: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What has no output yet."""
    return entries if force else entries.join(outputs.select(key).distinct(), key, "left_anti")


def score_stream(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, out: str, per_batch: int = 1, seconds: float | None = None) -> DataFrame:
    """Scores new files as they come and stops when there are none, or after so many seconds: (lang, n, correct) over all batches.

    Each batch's counts are a folder of their own, written over if the batch runs again, so a
    restart neither loses nor repeats one.  A run that is out of time goes on where it stopped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)

    def score(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gt")).alias("correct"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    running = stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    within(running, float("inf") if seconds is None else seconds)
    counts = "lang string, n long, correct long"
    return spark.read.schema(counts).parquet(out).groupBy("lang").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))


PROTOCOL = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("action", T.StringType()), T.StructField("accepted", T.BooleanType()), T.StructField("steps_used", T.LongType())])


def check_protocol(stream: DataFrame, most_steps: int = 28) -> DataFrame:
    """Each action against its question's state: out of order, or beyond the steps, is rejected and changes nothing.

    Rows of a question within a batch are taken by step; the state is the last accepted action and the steps used.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, used = state.get if state.exists else ("", 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("step").itertuples():
            used += 1
            good = row.action in MOVES.get(last, ()) and used <= most_steps
            last = row.action if good else last
            out.append((key[0], row.step, row.action, good, used))
        state.update((last, used))
        yield pd.DataFrame(out, columns=PROTOCOL.names)

    kept = T.StructType([T.StructField("last", T.StringType()), T.StructField("used", T.LongType())])
    return stream.groupBy("question_id").applyInPandasWithState(step, PROTOCOL, kept, "append", GroupStateTimeout.NoTimeout)


def responder(rows: DataFrame, respond, schema: str, workers: int = 1, at_once: int = 64) -> DataFrame:
    """Rows through a model, partition by partition: respond takes and gives pandas frames of the schema; `error` is added.

    Stands where a network or a model would be; tests use a deterministic one.  Each partition has `workers` requests of `at_once` rows
    under way, and twice as many waiting at most; responses come in the order of their rows.  If it fails on a request, its rows go one by
    one, and a row whose response fails carries the error's name instead of ending the run: its other columns are null but
    for those that it came with.
    """
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def one(row: pd.DataFrame) -> pd.DataFrame:
        try:
            return respond(row).assign(error=None)
        except Exception as e:  # noqa: BLE001  the row's outcome
            return row.reindex(columns=names).assign(error=type(e).__name__)

    def some(part: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [respond(part).assign(error=None)]
        except Exception:  # noqa: BLE001  some row of the request
            return [one(part.iloc[k : k + 1]) for k in range(len(part))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            under_way: deque = deque()
            for pdf in frames:
                for k in range(0, len(pdf), at_once):
                    if len(under_way) >= 3 * workers:
                        yield from under_way.popleft().result()
                    under_way.append(pool.submit(some, pdf.iloc[k : k + at_once]))
            while under_way:
                yield from under_way.popleft().result()

    return rows.mapInPandas(run, f"{schema}, error string")


def within(query: StreamingQuery, seconds: float) -> bool:
    """Let the query run for so long: true if it has ended by itself, false if it was stopped.

    What was stopped goes on from its checkpoint: batches that were done are not done again, and the one that was cut off is.
    """
    end = time.monotonic() + seconds
    while query.isActive:
        left = end - time.monotonic()
        if left <= 0:
            query.stop()
            return False
        query.awaitTermination(min(left, 1.0))
    if query.exception() is not None:
        raise query.exception()
    return True
