"""Access records as state for each node, with timers that close sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where state with timers is kept (a setting's fixed value).
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

PROFILE = "n long, first long, last long, session long, opened long, inside long, closed boolean, hours array<long>, days array<long>"
DAY = 86_400_000


class Accesses(StatefulProcessor):
    """Folds the accesses of a node in order of time and emits each session once it
    can't grow.

    Accesses wait until the watermark has passed them, so those that arrive out of
    order, but not too late, count as if they had come in order.  A timer fires for
    the first that waits, and for the end of the open session.
    """

    def __init__(self, key: str, gap: int) -> None:
        self.key, self.gap = key, gap * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", PROFILE)
        self.waiting = handle.getListState("waiting", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t) for part in rows for t in part["millis"]]
        yield from self._advance(key, times, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, times: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        held = sorted([*times, *(int(t[0]) for t in self.waiting.get())])
        due, rest = [t for t in held if t <= watermark], [t for t in held if t > watermark]
        n, first, last, session, opened, inside, closed, hours, days = self.profile.get() if self.profile.exists() else (0, None, None, 0, None, 0, True, [0] * 24, [0] * 7)
        hours, days, out = list(hours), list(days), []
        emit = lambda: out.append((key[0], session, opened, last, inside, n, hours.index(max(hours)), days.index(max(days))))
        for t in due:
            if last is None or t - last > self.gap:
                if not closed:
                    emit()
                session, opened, inside, closed = session + 1, t, 0, False
            n, first, last, inside = n + 1, t if first is None else first, t, inside + 1
            hours[t % DAY // 3_600_000] += 1
            days[(t // DAY + 4) % 7] += 1
        if not closed and last + self.gap < watermark:
            emit()
            closed = True
        self.profile.update((n, first, last, session, opened, inside, closed, hours, days))
        if rest:
            self.waiting.put([(t,) for t in rest])
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_ = min([*rest[:1], *([] if closed else [last + self.gap + 1])], default=None)
        if next_ is not None:
            self.handle.registerTimer(max(next_, watermark + 1))
        if out:
            frame = pd.DataFrame(out, columns=[self.key, "session", "start", "end", "n", "total", "hour", "day"])
            for c in ("start", "end"):
                frame[c] = pd.to_datetime(frame[c], unit="ms", utc=True)
            yield frame

    def close(self) -> None:
        pass


def tracked(events: DataFrame, key: str = "node", ts: str = "ts", gap: int = 300, late: str = "10 minutes") -> DataFrame:
    """``key``, ``session``, ``start``, ``end``, ``n``, ``total``, ``hour``, ``day`` of each session of
    a stream of accesses, once no access within ``gap`` seconds can follow.

    ``session`` counts from 1, ``n`` are its accesses and ``total`` all up to its end, of
    which ``hour`` (UTC) and ``day`` (0 is Sunday) had most.  Times count in milliseconds.
    Null keys and times are left out, as is what comes over ``late`` late.  The session
    must keep state in the provider that :data:`PROVIDER` names.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(f"`{key}` is not null and `{ts}` is not null").withWatermark(ts, late).selectExpr(f"`{key}`", f"`{ts}`", f"unix_millis(`{ts}`) as millis")
    return rows.groupBy(key).transformWithStateInPandas(
        Accesses(key, gap), f"`{key}` {kind}, session long, start timestamp, end timestamp, n long, total long, hour long, day long", "Append", "EventTime")
