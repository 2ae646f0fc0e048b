"""Operators with state and bounds: caches that forget, deadlines.

The stateful ones run on streams, where the state lives from batch to batch and through a restart, and on tables, as one batch.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .incremental import MOVES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """What operators on state variables need of a session: a store for them, and, for tables, whoever keeps track of stores."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active


def _in_order(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class _Cache(StatefulProcessor):
    """The requests that are held, each with the number of its last use; at most `capacity` of them."""

    def __init__(self, key: str, request: str, order: str, capacity: int):
        self.columns, self.order, self.capacity = (key, order, request), order, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "request string", "used long")
        self.clock = handle.getValueState("clock", "used long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the state is small: it is read once for all rows of the key, and what changed is written back
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        cache: OrderedDict[str, int] = OrderedDict(sorted(before.items(), key=lambda x: x[1]))
        clock = self.clock.get()[0] if self.clock.exists() else 0
        batch = _in_order(rows, self.order)
        found, evicted = [], []
        for request in batch[self.columns[2]]:
            clock += 1
            known = request in cache
            cache[request] = clock
            cache.move_to_end(request)
            found.append(known)
            evicted.append(cache.popitem(last=False)[0] if len(cache) > self.capacity else None)
        for request in before.keys() - cache.keys():
            self.held.removeKey((request,))
        for request, used in cache.items():
            if before.get(request) != used:
                self.held.updateValue((request,), (used,))
        self.clock.update((clock,))
        yield batch[list(self.columns)].assign(hit=found, evicted=pd.Series(evicted, index=batch.index, dtype=object))

    def close(self) -> None:
        pass


def cached_requests(rows: DataFrame, key: str, request: str, order: str, capacity: int = 3) -> DataFrame:
    """key, order, request, hit, evicted: each key's requests through its own cache of least recent use, of bounded size.

    Requests of a key within a batch are taken by `order`; later batches find the cache as the earlier ones left it.  A null request is one like
    any other.  evicted: the request that had to go, null if none.
    """
    if capacity < 1:
        raise ValueError("a cache holds one request at least")
    with_state(rows.sparkSession)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"{key} {kind[key]}, {order} {kind[order]}, {request} string, hit boolean, evicted string"
    named = rows.select(key, order, rows[request].cast("string").alias(request))
    return named.groupBy(key).transformWithStateInPandas(_Cache(key, request, order, capacity), schema, "append", "none")


EXPIRING = T.StructType([T.StructField("question_id", T.LongType()), T.StructField("step", T.LongType()), T.StructField("action", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("steps_used", T.LongType())])


class _Protocol(StatefulProcessor):
    """A question's last accepted action and steps used; one timer, moved on by each accepted action."""

    def __init__(self, seconds: float, most_steps: int):
        self.wait, self.most_steps = int(1000 * seconds), most_steps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "last string, used long, timer long")

    def _later(self, now: int, timer: int | None) -> int:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.wait)
        return now + self.wait

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, used, timer = self.kept.get() if self.kept.exists() else ("", 0, None)
        out, accepted = [], timer is None
        for row in _in_order(rows, "step").itertuples():
            used += 1
            good = row.action in MOVES.get(last, ()) and used <= self.most_steps
            last, accepted = (row.action, True) if good else (last, accepted)
            out.append((key[0], row.step, row.action, "accepted" if good else "rejected", used))
        if last == "final_answer":
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = None
        elif accepted:
            timer = self._later(timerValues.getCurrentProcessingTimeInMs(), timer)
        self.kept.update((last, used, timer))
        yield pd.DataFrame(out, columns=EXPIRING.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, used, _ = self.kept.get()
        self.kept.clear()
        yield pd.DataFrame([(key[0], None, last, "expired", used)], columns=EXPIRING.names).astype({"step": "Int64"})

    def close(self) -> None:
        pass


def check_deadlines(stream: DataFrame, seconds: float, most_steps: int = 28) -> DataFrame:
    """Actions of questions (question_id, step, action), each accepted or rejected, and a row `expired` for a question that saw no accepted action for so long.

    An answered question does not expire; one that has expired is forgotten, and begins anew if it is asked again.
    """
    with_state(stream.sparkSession)
    return stream.groupBy("question_id").transformWithStateInPandas(_Protocol(seconds, most_steps), EXPIRING, "append", "processingTime")
