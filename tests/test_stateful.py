"""Caches, deadlines, time budgets and bounded concurrency."""

import random
import time
from collections import OrderedDict, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlspan.streaming import incremental, stateful


def plain_cache(rows, capacity):
    """(key, order, request, hit, evicted) of rows by key and order."""
    caches, out = defaultdict(OrderedDict), []
    for key, order, request in sorted(rows, key=lambda r: r[1]):
        cache = caches[key]
        hit = request in cache
        cache[request] = True
        cache.move_to_end(request)
        gone = cache.popitem(last=False)[0] if len(cache) > capacity else None
        out.append((key, order, request, hit, gone))
    return sorted(out, key=str)


def requests(n, seed=1):
    rng = random.Random(seed)
    return [(rng.randint(0, 3), k, rng.choice("abcdefgh"[: rng.randint(2, 8)])) for k in range(n)]


@pytest.mark.parametrize("capacity", [1, 3])
def test_cache_over_a_table(spark, capacity):
    rows = requests(300)
    df = spark.createDataFrame(rows, "worker long, at long, clip string").repartition(3)
    assert sorted(map(tuple, stateful.cached_requests(df, "worker", "clip", "at", capacity).collect()), key=str) == plain_cache(rows, capacity)
    with pytest.raises(ValueError):
        stateful.cached_requests(df, "worker", "clip", "at", 0)


def test_cache_lives_from_batch_to_batch(spark, tmp_path):
    rows = requests(200, 2)
    schema = "worker long, at long, clip string"
    for k in range(0, 200, 50):
        time.sleep(0.01)  # files are taken by their age
        spark.createDataFrame(rows[k : k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.cached_requests(stream, "worker", "clip", "at").writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert incremental.within(out, 120)
    assert sorted(map(tuple, spark.table("cached").collect()), key=str) == plain_cache(rows, 3)


def test_deadlines(spark, tmp_path):
    schema = "question_id long, step long, action string"
    folder = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put((1, 0, "choose_bucket"), (1, 1, "choose_candidate"), (2, 0, "choose_bucket"), (2, 1, "final_answer"))
    checked = stateful.check_deadlines(spark.readStream.schema(schema).parquet(folder), seconds=3)
    run = checked.writeStream.format("memory").queryName("deadlines").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        found = lambda: {(r.question_id, r.step, r.outcome, r.steps_used) for r in spark.table("deadlines").collect()}
        end = time.monotonic() + 90
        while (1, None, "expired", 2) not in found() and time.monotonic() < end:
            time.sleep(0.5)
        put((1, 2, "name_subject"), (1, 3, "choose_bucket"), (2, 2, "choose_bucket"))
        while len(found()) < 8 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        run.stop()
    # the answered question stays closed, the expired one begins anew
    assert {(1, 0, "accepted", 1), (1, 1, "rejected", 2), (2, 0, "accepted", 1), (2, 1, "accepted", 2), (1, None, "expired", 2), (1, 2, "rejected", 1), (1, 3, "accepted", 2), (2, 2, "rejected", 3)} <= found()
    assert not [r for r in found() if r[0] == 2 and r[2] == "expired"]


def test_a_run_out_of_time_goes_on_later(spark, tmp_path):
    rows = spark.createDataFrame([(k, "en" if k % 2 else "fr", "A" if k % 3 else "B", "A") for k in range(40)], "k long, lang string, pred string, gt string")
    rows.repartition(20).write.parquet(str(tmp_path / "in"))
    run = lambda seconds: incremental.score_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "ck"), str(tmp_path / "out"), seconds=seconds)
    (tmp_path / "out").mkdir()
    began = time.monotonic()
    part = sum(r.n for r in run(1.5).collect())
    assert part < 40 and time.monotonic() - began < 30
    whole = {(r.lang, r.n, r.correct) for r in run(None).collect()}
    assert whole == {(r.lang, r.n, r.correct) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("gt")).alias("correct")).collect()}


@pytest.mark.parametrize("workers", [1, 3])
def test_requests_under_way_are_bounded(spark, workers):
    shared = {}

    def respond(part: pd.DataFrame) -> pd.DataFrame:
        import threading
        import time

        lock = shared.setdefault("lock", threading.Lock())
        with lock:
            shared["now"] = shared.get("now", 0) + 1
            now = shared["now"]
        try:
            time.sleep(0.05 + 0.01 * (part["x"].iloc[0] % 3))
            if (part["x"] == 17).any():
                raise KeyError(17)
            return part.assign(under_way=now)
        finally:
            with lock:
                shared["now"] -= 1

    rows = spark.range(40).withColumnRenamed("id", "x").coalesce(1)
    found = incremental.responder(rows, respond, "x long, under_way long", workers, at_once=2).collect()
    assert [r.x for r in found] == list(range(40))
    assert [(r.x, r.under_way, r.error) for r in found if r.error] == [(17, None, "KeyError")]
    assert max(r.under_way for r in found if not r.error) == workers
