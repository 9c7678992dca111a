"""State by key that lives as long as its stream: events folded in their own order, not the order they come in.

An event is applied once the watermark has passed it; until then it waits in the key's state, so that late and shuffled events fall into place, and each batch's output is what the state would be
if nothing more came.  Events that come again are known by their place in the order and change nothing.  State lies in the RocksDB store; a restart from the checkpoint goes on where the last batch ended.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """The state store that keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class OrderedFold(StatefulProcessor):
    """``step(state, value)`` over a key's events by (time, id).  State and values are anything that JSON holds; ``row`` makes an output row's values of a state.

    A call has the events of one part of the keys, since what Spark spends on a call is many times what a key's events cost; state lies by key within the part, and only that of keys that something
    has come for is read and written.  A timer settles what waits with keys that nothing more comes for; their rows stay as they are, so it puts out none.
    """

    def __init__(self, start, step: Callable, row: Callable, names: list[str], ttl_ms: int | None = None):
        self.start, self.step, self.row, self.names, self.ttl_ms = start, step, row, names, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getMapState("settled", "key string", "state string, at long, id long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "key string", "events string", self.ttl_ms)
        self.alarm = handle.getValueState("alarm", "at long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came, out, newest = {}, [], None
        for pdf in rows:
            for k, at, i, v in zip(pdf["key"], pdf["at"], pdf["id"], pdf["value"]):
                came.setdefault(k, {})[int(at), int(i)] = v
        waiting, settled = self.waiting.exists(), self.settled.exists()  # of a part without state, keys need not be asked for
        for k, events in came.items():
            before = self.waiting.getValue((k,)) if waiting else None
            state, last = self._settle(k, (_events(before[0]) if before else {}) | events, before is not None, settled, timerValues.getCurrentWatermarkInMs())
            out.append((k, *self.row(state)))
            newest = _later(newest, last)
        if newest is not None and not self.alarm.exists():
            self._wake(newest)
        yield pd.DataFrame(out, columns=["key", *self.names])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark, settled, newest = timerValues.getCurrentWatermarkInMs(), self.settled.exists(), None
        for (k,), (text,) in list(self.waiting.iterator()):
            events = _events(text)
            due = min(events)[0] < watermark * 1000
            newest = _later(newest, self._settle(k, events, True, settled, watermark)[1] if due else max(events)[0])
        if newest is None:
            self.alarm.clear()
        else:
            self._wake(newest)
        return iter(())

    def _wake(self, newest: int) -> None:
        """One timer a part, for when all that waits there now will be settled."""
        self.alarm.update((newest,))
        self.handle.registerTimer(newest // 1000 + 1)

    def _settle(self, key: str, held: dict, waited: bool, settled: bool, watermark: int) -> tuple:
        """(the key's state if nothing more comes, the time of its last event that waits or None): what the watermark has passed goes into the settled state, the rest waits.
        ``waited``, ``settled``: whether something of the key's waited before, and whether it may have a settled state."""
        before = self.settled.getValue((key,)) if settled else None
        state, last = (json.loads(before[0]), (before[1], before[2])) if before else (self.start, (-(1 << 62), 0))
        places = sorted(p for p in held if p > last)
        n = bisect_left(places, (watermark * 1000,))
        for p in places[:n]:
            state, last = self.step(state, held[p]), p
        if n or (before and self.ttl_ms):
            self.settled.updateValue((key,), (json.dumps(state), *last))
        later = [(*p, held[p]) for p in places[n:]]
        if later:
            self.waiting.updateValue((key,), (json.dumps(later),))
        elif waited:
            self.waiting.removeKey((key,))
        for *_, v in later:
            state = self.step(state, v)
        return state, later[-1][0] if later else None

    def close(self) -> None:
        pass


def _events(text: str) -> dict:
    return {(at, i): v for at, i, v in json.loads(text)}


def _later(a: int | None, b: int | None) -> int | None:
    return max((x for x in (a, b) if x is not None), default=None)


#: Parts that keys are dealt to.  State is found by part, so this stays as it is while a checkpoint lives.
PARTS = 1024
#: How a key of any columns is written as text and read again, with all digits of a time.
KEY_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def ordered_fold(events: DataFrame, keys: list[str], ts: str, id_: str, value: str, start, step: Callable, row: Callable, out: str, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """The running state of each key, in update mode: ``keys`` and the columns of ``out`` (DDL).

    Events of one key are ordered by ``ts`` and ``id_`` (a whole number).  ``late``: how long an event may be behind the newest one; one that is later still is dropped by the watermark.  ``ttl_ms``:
    forget keys that nothing has come for.
    """
    use_store(events.sparkSession)
    names = [c.split()[0] for c in out.split(", ")]
    rows = events.withWatermark(ts, late).select(
        F.to_json(F.struct(*keys), KEY_TEXT).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), F.col(id_).cast("long").alias("id"), F.col(value).alias("value")
    )
    parted = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    running = parted.groupBy("part").transformWithStateInPandas(OrderedFold(start, step, row, names, ttl_ms), f"key string, {out}", "Update", "EventTime")
    return running.select(F.from_json("key", events.select(*keys).schema, KEY_TEXT).alias("key"), *names).select("key.*", *names)


def mark_step(state: list, kind: str | None) -> list:
    """One event on [saved, attending, dismissed, tracked, feedback]: the rules of ``state.marks``."""
    saved, attending, dismissed, tracked, feedback = state
    if kind == "save":
        saved, dismissed = not saved, False
    elif kind == "attend":
        attending = not attending
        dismissed = dismissed and not attending
    elif kind == "track":
        tracked = not tracked
    elif kind == "more":
        feedback = "more"
    elif kind in ("dismiss", "less"):
        dismissed = True if kind == "less" else not dismissed
        feedback = "less" if kind == "less" else feedback
        if dismissed:
            saved = attending = False
    return [saved, attending, dismissed, tracked, feedback]


def marks(events: DataFrame, user: str, item: str, kind: str, ts: str, id_: str, late: str = "10 minutes") -> DataFrame:
    """``state.marks`` as a stream."""
    out = "saved boolean, attending boolean, dismissed boolean, tracked boolean, feedback string"
    return ordered_fold(events, [user, item], ts, id_, kind, [False, False, False, False, None], mark_step, tuple, out, late)


def bias(events: DataFrame, user: str, signal: str, delta: str, ts: str, id_: str, limit: int = 20, late: str = "10 minutes") -> DataFrame:
    """``state.bias_fold`` as a stream."""
    return ordered_fold(events, [user, signal], ts, id_, delta, 0, lambda s, d: max(-limit, min(limit, s + d)), lambda s: (s,), "bias int", late)
