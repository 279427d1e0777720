"""Events of a key taken in the order of their times, however they are dealt to micro-batches.

An event waits in the state of its key until the watermark has passed its time; then it and those
that wait with it go through a small machine, ordered by time and event_id. What a machine owes at
some later time, such as the end of a job, is settled by a timer. So results don't depend on files
or batches: an event that arrives late but within the watermark's delay takes its place, a later
one is dropped by the watermark. A key holds its machine's state and the events of one delay; keys are kept and called for
in groups by hash.

Defined cases: a null key is a key, and NaN counts as null; a null time is never passed by the watermark, and such an event is dropped; events with the same
time go by event_id, those without one first; kinds that a machine doesn't know change nothing. At the end of a feed what
lies behind the last watermark still waits, as it must; ``closing`` makes a row that lets all of it pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys go to so many groups of state, by hash: a call, its rows and its state cost Spark some milliseconds, whether of one key or of a thousand.
GROUPS = 512
#: The group of null keys.
NULLS = -1
#: Answers in a row between Python and Spark, which pads each row with an empty state: that cost more than an answer itself.
TOGETHER = 1000
#: What is kept of an event that waits.
WAITS = ["_at", "_known", "event_id", "_key", "kind"]
STATE = StructType([StructField("keys", BinaryType())])


class Machine(Protocol):
    """Times are microseconds. A state is a tuple of plain values that is replaced, never changed, or None where there is nothing to hold."""

    def take(self, held: Any, at: int, event: int | None, kind: str | None) -> tuple[Any, list[tuple]]:
        """The state after an event, and answers of event_id, at and what else the machine returns."""

    def due(self, held: Any) -> int | None:
        """When the state changes by itself."""

    def lapse(self, held: Any) -> tuple[Any, list[tuple]]:
        """The state after that, and answers."""


class InOrder:
    """Runs a machine for each key of a group over its events in order; Spark hands over the group's state with its rows, once a micro-batch.

    The state is the columns of the events that wait, kinds as numbers, and, of the keys whose machine holds something, what that is. Only
    events that the watermark has passed are taken out of the table one by one.
    """

    def __init__(self, machine: Machine, fields: list[str]) -> None:
        self.machine, self.fields = machine, fields

    def __call__(self, group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, held = pickle.loads(state.get[0]) if state.exists else (None, {})
        tables = [] if waiting is None else [[*waiting[:-1], waiting[-1][1].take(waiting[-1][0])]]
        tables += ([rows[c].to_numpy() for c in WAITS] for rows in batches)
        passed = state.getCurrentWatermarkMs() * 1000
        events: dict[Any, list[tuple]] = {}
        left, answers, nexts, waiting = {}, [], [], None
        if tables:
            rows = [np.concatenate(column) for column in zip(*tables, strict=True)]
            waits = rows[0] > passed
            if not waits.all():
                events = self._by_key([column[~waits] for column in rows], group[0] != NULLS)
                rows = [column[waits] for column in rows]
            if len(rows[0]):
                nexts.append(int(rows[0].min()))
                codes, kinds = pd.factorize(rows[-1], use_na_sentinel=False)
                waiting = [*rows[:-1], (codes.astype(np.min_scalar_type(len(kinds))), kinds)]
        for key in dict.fromkeys([*held, *events]):
            after, due = self._settled(key, held.get(key), events.get(key, ()), passed, answers)
            if after is not None:
                left[key] = after
            if due:
                nexts.append(due)
        if waiting is not None or left:
            state.update((pickle.dumps((waiting, left), pickle.HIGHEST_PROTOCOL),))
            if nexts:
                # Spark calls when the watermark is past that; by then the event or the lapse is due.
                state.setTimeoutTimestamp(max(min(nexts) // 1000, passed // 1000 + 1))
        elif state.exists:
            state.remove()
        if answers:
            parts = [list(zip(*answers[i : i + TOGETHER], strict=True)) for i in range(0, len(answers), TOGETHER)]
            yield pd.DataFrame({name: pd.Series([list(part[i]) for part in parts], dtype=object) for i, name in enumerate(self.fields)}, copy=False)

    def _by_key(self, rows: list[np.ndarray], keyed: bool) -> dict[Any, list[tuple]]:
        """Each key with its events in order."""
        at, known, number, key, kind = rows
        codes, names = pd.factorize(key) if keyed else (np.zeros(len(at), np.int64), [None])
        order = np.lexsort((number, known, at, codes))
        ids = number[order].tolist() if known.all() else [n if k else None for n, k in zip(number[order].tolist(), known[order].tolist(), strict=True)]
        events = list(zip(at[order].tolist(), ids, kind[order].tolist(), strict=True))
        ends = np.cumsum(np.bincount(codes)).tolist()
        return {name: events[start:end] for name, start, end in zip(pd.Index(names).tolist(), [0, *ends[:-1]], ends, strict=True)}

    def _settled(self, key, held, events: Iterable[tuple], passed: int, answers: list) -> tuple[Any, int | None]:
        """What the machine holds once all that was due by ``passed`` is settled, and when it changes by itself."""
        said, due = [], self._due(held)
        for at, event, kind in events:
            if due is not None and due <= at:
                held, due = self._lapsed(held, due, at, said)
            after, more = self.machine.take(held, at, event, kind)
            if after is not held:
                held, due = after, self._due(after)
            said += more
        held, due = self._lapsed(held, due, passed, said)
        answers += ((key, *answer) for answer in said)
        return held, due

    def _due(self, held) -> int | None:
        return None if held is None else self.machine.due(held)

    def _lapsed(self, held, due: int | None, upto: int, said: list) -> tuple[Any, int | None]:
        while due is not None and due <= upto:
            held, more = self.machine.lapse(held)
            due = self._due(held)
            said += more
        return held, due


def in_order(events: DataFrame, key: str, machine: Machine, answer: StructType, delay: str) -> DataFrame:
    """``key`` and the columns of ``answer``, as the machine gives them. ``events`` is a stream of event_id, ``key``, ts and kind."""
    kept = F.nanvl(F.col(key), F.lit(None)) if isinstance(events.schema[key].dataType, (FloatType, DoubleType)) else F.col(key)
    # A null id goes as a number and a mark, and null keys in a group of their own: pandas would make decimals of the numbers beside a null.
    number = F.coalesce(F.col("event_id").cast("bigint"), F.lit(0)).alias("event_id")
    group = F.when(kept.isNull(), NULLS).otherwise(F.pmod(F.xxhash64(kept), F.lit(GROUPS))).cast("int")
    rows = events.where("ts is not null").select(
        group.alias("_group"), kept.alias("_key"), number, F.col("event_id").isNotNull().alias("_known"), F.col("ts").cast("timestamp").alias("ts"), F.col("kind").cast("string").alias("kind")
    )
    rows = rows.withWatermark("ts", delay).withColumn("_at", F.unix_micros("ts"))
    fields = [StructField("_key", rows.schema["_key"].dataType), *answer.fields]
    names = [f.name for f in fields]
    lists = StructType([StructField(f.name, ArrayType(f.dataType)) for f in fields])
    found = rows.groupBy("_group").applyInPandasWithState(InOrder(machine, names), lists, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.inline(F.arrays_zip(*names))).select(F.col("_key").alias(key), *names[1:])


def closing(events: DataFrame, key: str, days: int) -> DataFrame:
    """One row in the form of ``events`` (event_id, ``key``, ts, kind), of no key, so much later than all of them that nothing waits behind it."""
    last = events.agg(F.max("ts").alias("ts"))
    nothing = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    return last.select(nothing("event_id"), nothing(key), (F.col("ts") + F.expr(f"interval {days} days")).alias("ts"), nothing("kind")).select(*events.columns)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on disk rather than in the memory of an executor."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
