"""Windows that slide over a stream of bars: the fixed-window indicators, bar by bar.

A series' state holds its last bars in a ring, the running sums of each window, the moments of fitted lines, and for
extremes a queue of the bars that can still become one, so a bar costs the same however wide a window is. Sums are
taken anew each time a ring has gone round, so rounding doesn't add up. State is one row of arrays a series.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources.bars import SERIES


class Mean:
    """The mean of the last n values, None while there are fewer than `least`."""

    def __init__(self, n: int, least: int | None = None, values: list[float] = ()):
        self.n, self.least, self.ring, self.turn = n, least or n, deque(values, n), 0
        self.sum = math.fsum(self.ring)

    def add(self, x: float) -> float | None:
        self.sum += x - (self.ring[0] if len(self.ring) == self.n else 0.0)
        self.ring.append(x)
        self.turn += 1
        if self.turn == self.n:
            self.turn, self.sum = 0, math.fsum(self.ring)
        return self.sum / len(self.ring) if len(self.ring) >= self.least else None


class Extreme:
    """The largest of the last n values (sign 1) or the smallest (-1), None while there are fewer than `least`.

    The queue falls from its front: a value that a later one beats can't be the extreme any more.
    """

    def __init__(self, n: int, sign: int, least: int | None = None, seen: int = 0, queue: list[tuple[int, float]] = ()):
        self.n, self.sign, self.least, self.seen, self.queue = n, sign, least or n, seen, deque(queue)

    def add(self, x: float) -> float | None:
        while self.queue and self.sign * self.queue[-1][1] <= self.sign * x:
            self.queue.pop()
        self.queue.append((self.seen, x))
        self.seen += 1
        if self.queue[0][0] <= self.seen - 1 - self.n:
            self.queue.popleft()
        return self.queue[0][1] if self.seen >= self.least else None


class Line:
    """The end of the line fitted to the last n values, from their sum and their sum weighted by place."""

    def __init__(self, n: int, values: list[float] = ()):
        self.n, self.ring, self.turn = n, deque(values, n), 0
        self._anew()

    def _anew(self) -> None:
        self.sum, self.weighted = math.fsum(self.ring), math.fsum(i * y for i, y in enumerate(self.ring))

    def add(self, y: float) -> float | None:
        if len(self.ring) == self.n:  # all others move one place down
            gone = self.ring[0]
            self.weighted -= self.sum - gone
            self.sum -= gone
        self.weighted += min(len(self.ring), self.n - 1) * y
        self.sum += y
        self.ring.append(y)
        self.turn += 1
        if self.turn == self.n:
            self.turn = 0
            self._anew()
        if len(self.ring) < self.n:
            return None
        middle = (self.n - 1) / 2
        slope = (self.weighted - middle * self.sum) / (self.n * (self.n * self.n - 1) / 12)
        return self.sum / self.n + slope * middle


#: The returns' lengths.
RETURNS = (5, 20, 60, 120)
_VALUES = "mean_50 double, mean_200 double, max_60 double, min_60 double, volume_20 double, linreg_20 double, squeeze_on boolean, squeeze_off boolean, momentum double, " + ", ".join(f"ret_{n} double" for n in RETURNS)
OUT = f"source string, symbol string, timeframe string, bar_idx int, {_VALUES}"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
#: Rings by name, and queues as places and values.
_RINGS = ("closes", "volumes", "ranges", "away")
_QUEUES = ("top_60", "low_60", "top_20", "low_20")
STATE = "fed int, " + ", ".join(f"{r} array<double>" for r in _RINGS) + ", " + ", ".join(f"{q}_at array<int>, {q} array<double>" for q in _QUEUES)


class Indicators:
    """All windows of one series. It can be written as a row of STATE and made from one."""

    def __init__(self, fed: int = 0, **state: Any):
        get = lambda name: list(state.get(name) or ())
        queue = lambda name: list(zip(get(f"{name}_at"), get(name), strict=True))
        closes, self.fed = get("closes"), fed
        self.closes = deque(closes, 201)
        self.mean_20, self.mean_50, self.mean_200 = Mean(20, values=closes[-20:]), Mean(50, 10, closes[-50:]), Mean(200, values=closes[-200:])
        self.volume, self.ranges, self.away = Mean(20, 5, get("volumes")), Mean(20, values=get("ranges")), Line(20, get("away"))
        self.line = Line(20, closes[-20:])
        self.top_60, self.low_60 = Extreme(60, 1, 10, fed, queue("top_60")), Extreme(60, -1, 10, fed, queue("low_60"))
        self.top_20, self.low_20 = Extreme(20, 1, 20, fed, queue("top_20")), Extreme(20, -1, 20, fed, queue("low_20"))

    def row(self) -> tuple:
        queues = [(q.queue, [i for i, _ in q.queue]) for q in (self.top_60, self.low_60, self.top_20, self.low_20)]
        rings = [list(map(float, r)) for r in (self.closes, self.volume.ring, self.ranges.ring, self.away.ring)]
        return (self.fed, *rings, *[x for queue, at in queues for x in (at, [float(v) for _, v in queue])])

    def add(self, high: float, low: float, close: float, volume: float) -> tuple:
        """The values at this bar, in the order of OUT."""
        before = self.closes[-1] if self.closes else None
        reach = high - low if before is None else max(high - low, abs(high - before), abs(low - before))
        self.closes.append(close)
        self.fed += 1
        mean_50, mean_200, top, bottom, volume_20 = self.mean_50.add(close), self.mean_200.add(close), self.top_60.add(high), self.low_60.add(low), self.volume.add(volume)
        line, mid, range_20 = self.line.add(close), self.mean_20.add(close), self.ranges.add(reach)
        top_20, low_20 = self.top_20.add(high), self.low_20.add(low)
        on = off = False
        momentum = None
        if mid is not None:
            sd = math.sqrt(math.fsum((x - mid) ** 2 for x in self.mean_20.ring) / 20)
            upper, lower, wide, narrow = mid + 2 * sd, mid - 2 * sd, mid + 1.5 * range_20, mid - 1.5 * range_20
            on, off = upper < wide and lower > narrow, upper > wide and lower < narrow
            momentum = self.away.add(close - ((top_20 + low_20) / 2 + mid) / 2)
        returns = [math.log(close / self.closes[-1 - n]) if len(self.closes) > n and self.closes[-1 - n] and close / self.closes[-1 - n] > 0 else None for n in RETURNS]
        return mean_50, mean_200, top, bottom, volume_20, line, on, off, momentum, *returns


class Sliding(StatefulProcessor):
    """Bars of a series come in the order of bar_idx over batches; one that came before is a repeat and gives nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("windows", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATE.split(", ")]
        own = Indicators(**dict(zip(names, self.state.get(), strict=True))) if self.state.exists() else Indicators()
        out = []
        for b in pd.concat(list(rows)).sort_values("bar_idx").itertuples():
            if b.bar_idx == own.fed:
                out.append((*key, b.bar_idx, *own.add(b.high, b.low, b.close, b.volume)))
        self.state.update(own.row())
        yield pd.DataFrame(out, columns=_NAMES)

    def close(self) -> None:
        pass


def sliding(bars: DataFrame) -> DataFrame:
    """A row for each bar of a stream, with what the batch queries give for it."""
    return bars.select(*SERIES, "bar_idx", "high", "low", "close", "volume").groupBy(*SERIES).transformWithStateInPandas(Sliding(), OUT, "append", "none")
