"""Alert rules on a stream with typed state that empties itself.

The rules are about order: each row is judged by what was accepted before it.  Rows wait in the state of their channel
until the watermark has passed their time, so micro-batches may bring them in any order; then a timer applies the rules to
them in order of time.  An alert leaves the state when it is 60 seconds old, and a channel's last accepted time with it:
an idle channel holds nothing.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import _ALERTS, WINDOW_S, alert_outcomes

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


OUTCOMES = ("new", "merged", "cooldown", "rate_limited")
#: Waiting rows that are handed to the state at once.
HELD = 10_000


def waiting_rows(rows: Iterable[tuple]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """(at, kind, kinds) of rows (at, metric, severity) in order: times, and a number into kinds, the (metric, severity) that occur.

    A channel may have very many rows waiting: twelve bytes are held of each.
    """
    at, kind, numbers = array("d"), array("i"), {}
    for t, metric, severity in rows:
        at.append(t)
        kind.append(numbers.setdefault((metric, severity), len(numbers)))
    kinds = sorted(numbers, key=lambda k: [(x is not None, x or "") for x in k])
    place = np.empty(len(kinds), np.int32)
    place[[numbers[k] for k in kinds]] = np.arange(len(kinds))
    times, placed = np.array(at, float), place[np.array(kind, np.intp)]
    order = np.lexsort((placed, times))
    return times[order], placed[order], kinds


def _rows(at: np.ndarray, kind: np.ndarray, kinds: list[tuple], start: int, end: int) -> Iterator[tuple]:
    return ((float(at[k]), *kinds[kind[k]]) for k in range(start, end))


class AlertProcessor(StatefulProcessor):
    """State of a channel: waiting rows, alerts inside the window, the time of the last accepted row.

    A timer stands at the first waiting row's time, and one where the window of the last accepted row ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at double, metric string, severity string")
        self.alerts = handle.getListState("alerts", "at double, metric string, severity string, count int")
        self.last = handle.getValueState("last", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first = math.inf
        while fresh := [(r["at"], r["metric"], r["severity"]) for r in islice(rows, HELD)]:
            self.waiting.appendList(fresh)
            first = min(first, min(r[0] for r in fresh))
        if first < math.inf:
            self.handle.registerTimer(math.ceil(first * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # nothing up to here can come any more
        at, kind, kinds = waiting_rows(self.waiting.get() if self.waiting.exists() else ())
        due = int(np.searchsorted(at * 1000, now, "right"))
        alerts = [dict(zip(("at", "metric", "severity", "count"), r)) for r in self.alerts.get()] if self.alerts.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        state, told = {"last": last, "alerts": alerts}, array("b")
        counts = array("q")
        for outcome, n in alert_outcomes(_rows(at, kind, kinds, 0, due), state):
            told.append(OUTCOMES.index(outcome))
            counts.append(n)
        if due < len(at):
            later = _rows(at, kind, kinds, due, len(at))
            self.waiting.put(list(islice(later, HELD)))
            while more := list(islice(later, HELD)):
                self.waiting.appendList(more)
            self.handle.registerTimer(math.ceil(float(at[due]) * 1000))
        else:
            self.waiting.clear()
        self._put(self.alerts, [(a["at"], a["metric"], a["severity"], a["count"]) for a in state["alerts"] if now / 1000 - a["at"] < WINDOW_S])
        if state["last"] is None or now / 1000 - state["last"] >= WINDOW_S:
            self.last.clear()
        elif due:  # by then the last alert is out of the window as well
            self.last.update((state["last"],))
            self.handle.registerTimer(math.ceil((state["last"] + WINDOW_S) * 1000))
        return (Row(channel=key[0], at=t, metric=metric, severity=severity, outcome=OUTCOMES[o], n=n) for (t, metric, severity), o, n in zip(_rows(at, kind, kinds, 0, due), told, counts))

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    def close(self) -> None:
        pass


def expiring_alerts(alerts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(channel, at, metric, severity, outcome, n) of a stream alerts(channel, ts, metric, severity); append mode.

    `at` is ts in seconds.  A row is judged when the stream has seen one of a time `late` after it; rows that come later
    than that are dropped, as are rows with a null channel or ts.  The session needs the RocksDB state store.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    timed = alerts.where("channel is not null and ts is not null").select("channel", F.col("ts").cast("timestamp").alias("ts"), "metric", "severity")
    rows = timed.withWatermark("ts", late).withColumn("at", F.unix_micros("ts") / 1e6)
    return rows.groupBy("channel").transformWithState(statefulProcessor=AlertProcessor(), outputStructType=_ALERTS, outputMode="Append", timeMode="eventTime")
