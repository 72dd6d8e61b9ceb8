"""Filters over long sequences, fed from rows sorted within partitions.

A key's rows pass through one task in order, batch by batch, and only the state
of the filter is kept between them, so a key may have any number of rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adaptive:
    """Settings of the adaptive filter (fixed values).

    ``trend``, ``stable``: the step a value above which the filter goes over to
    velocity and below which it goes back, ``hold`` values at least after a change.
    ``window``: innovations from which the basic filter's noise is taken anew, each
    ``every`` values; 0 leaves it as it is.
    """

    trend: float = 0.1
    stable: float = 0.02
    hold: int = 10
    velocity_first: bool = False
    covariance: float = 30.0
    process: float = 0.0001
    noise: float = 88.0
    window: int = 0
    every: int = 10
    scale: float = 10.0
    least_noise: float = 1.0
    least_innovations: int = 5
    position_covariance: float = 100.0
    velocity_covariance: float = 10.0
    position_process: float = 0.1
    velocity_process: float = 0.01
    velocity_noise: float = 1.0


class AdaptiveFilter:
    """A filter that smooths while values are steady and follows while they trend.

    The basic filter goes on by its last change and corrects; the velocity filter
    has the change as a state of its own.  Only the one in use sees a value; at a
    change the other takes over its place and step.
    """

    def __init__(self, s: Adaptive) -> None:
        self.s, self.velocity, self.since, self.n = s, s.velocity_first, 0, 0
        self.x = self.last = 0.0
        self.p, self.r = s.covariance, s.noise
        self.place = self.speed = 0.0
        self.a, self.b, self.c, self.d = s.position_covariance, 0.0, 0.0, s.velocity_covariance
        self.innovations: deque[float] = deque(maxlen=s.window or 1)

    def step(self, z: float) -> float:
        """The filtered value of ``z``."""
        if self.velocity:
            out, trend = self._follow(z), self.speed
        else:
            out = self._smooth(z)
            trend = self.x - self.last
        self.n += 1
        self.since += 1
        if self.since >= self.s.hold:
            if not self.velocity and abs(trend) > self.s.trend:
                self.velocity, self.since, self.place, self.speed = True, 0, self.x, trend
            elif self.velocity and abs(trend) < self.s.stable:
                self.velocity, self.since, self.x, self.last = False, 0, self.place, self.place - self.speed
        return out

    def _smooth(self, z: float) -> float:
        ahead = self.x + (self.x - self.last)
        p = self.p + self.s.process
        gain = p / (p + self.r)
        self.last, self.x, self.p = ahead, ahead + gain * (z - ahead), (1 - gain) * p
        if self.s.window:
            self.innovations.append(z - ahead)
            if (self.n + 1) % self.s.every == 0 and (n := len(self.innovations)) >= self.s.least_innovations:
                mean = sum(self.innovations) / n
                spread = abs(sum(i * i for i in self.innovations) / n - mean * mean)
                self.r = max(self.s.least_noise, spread**0.5 * self.s.scale)
        return self.x

    def _follow(self, z: float) -> float:
        ahead = self.place + self.speed
        a, b, c, d = self.a + self.b + self.c + self.d + self.s.position_process, self.b + self.d, self.c + self.d, self.d + self.s.velocity_process
        total = a + self.s.velocity_noise
        g, h = a / total, c / total
        self.place, self.speed = ahead + g * (z - ahead), self.speed + h * (z - ahead)
        self.a, self.b, self.c, self.d = (1 - g) * a, (1 - g) * b, c - h * a, d - h * b
        return self.place


def kalman_adaptive(df: DataFrame, key: str = "node", order: str = "ts", value: str = "value", settings: Adaptive = Adaptive()) -> DataFrame:
    """``key``, ``order``, ``value``, ``n``, ``filtered``, ``mode``: each value after
    :class:`AdaptiveFilter`, which starts anew for each key; ``n`` counts from 1 and
    ``mode`` is ``basic`` or ``velocity``, as it is after the value.

    Null values and keys are left out; values of one time are taken in ascending
    order.  A key is one task's, in memory that doesn't grow with its rows.
    """
    rows = df.select(key, order, F.col(value).cast("double").alias(value)).where(F.col(key).isNotNull() & F.col(value).isNotNull())
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            n, filtered, mode = [], [], []
            for k, z in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or k != now:
                    now, state = k, AdaptiveFilter(settings)
                filtered.append(state.step(z))
                n.append(state.n)
                mode.append("velocity" if state.velocity else "basic")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(filtered, pa.float64()), pa.array(mode, pa.string())], [key, order, value, "n", "filtered", "mode"])

    dealt = rows.repartition(key).sortWithinPartitions(key, order, value)
    return dealt.mapInArrow(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, `{value}` double, n long, filtered double, mode string")
