"""The one sequential kernel: smoothed true range, and turning points at eight nested scales.

It works on the bars of one series in plain arrays; the batch operators call it once for each series, the
streaming one feeds it bar by bar. A turning point has two times: the bar of the extreme, and the bar at
which it was known. At the finest scale it is known once price has moved away from the extreme by theta
times the smoothed range; a coarser scale looks only at the turning points of the next finer one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: The scales' multiples of the smoothed range, its period, and how many bars it warms up.
THETAS = (0.5, 0.75, 1.1, 1.6, 2.4, 3.6, 5.4, 8.1)
PERIOD = 14
WARMUP = 14
HIGH, LOW = 1, -1


@dataclass
class Machine:
    """The state of one scale. feed() returns the turning point that an observation confirms, if any.

    An extreme is its price, its bar and the smoothed range there. Of the two only that counts which is looked for, and
    both at first: a reversal forgets all that came before it.
    """

    theta: float
    looking: int = 0  # for a HIGH, for a LOW, or for either at first
    top: tuple[float, int, float] | None = None
    bottom: tuple[float, int, float] | None = None

    @property
    def seeded(self) -> bool:
        return self.looking != 0 or self.top is not None

    def seed(self, high: float, low: float, at: int, span: float) -> None:
        self.top, self.bottom = (high, at, span), (low, at, span)

    def feed(self, high: float, low: float, at: int, span: float) -> tuple[int, float, int, bool, float] | None:
        """(bar, price, kind, whether it is the scale's first, range at the bar); at, span: the observation's bar and the range there."""
        rises, falls = self.looking != LOW and high > self.top[0], self.looking != HIGH and low < self.bottom[0]
        if rises:
            self.top = (high, at, span)
        if falls:
            self.bottom = (low, at, span)
        first = self.looking == 0
        # once a side is known, a new extreme on an observation can't be confirmed by it as well
        down = self.looking != LOW and (first or not rises) and self.top[0] - low >= self.theta * self.top[2]
        if down and first:
            down = self.top[0] - low >= high - self.bottom[0]
        if down:
            price, bar, there = self.top
            self.looking, self.top, self.bottom = LOW, None, (low, at, span)
            return bar, price, HIGH, first, there
        if self.looking != HIGH and (first or not falls) and high - self.bottom[0] >= self.theta * self.bottom[2]:
            price, bar, there = self.bottom
            self.looking, self.top, self.bottom = HIGH, (high, at, span), None
            return bar, price, LOW, first, there
        return None


@dataclass
class Lattice:
    """All scales of one series, fed bar by bar. What it holds doesn't grow with the bars."""

    thetas: tuple[float, ...] = THETAS
    period: int = PERIOD
    seen: int = 0
    span: float = 0.0
    close: float | None = None
    machines: list[Machine] = field(default_factory=list)
    waiting: list[list] = field(default_factory=list)  # of coarser scales: their first observation, until the second comes

    def __post_init__(self):
        self.machines = self.machines or [Machine(t) for t in self.thetas]
        self.waiting = self.waiting or [[] for _ in self.thetas]

    def state(self) -> str:
        """All that later points hang on, as text: two lattices with equal states go on alike. Numbers keep every bit."""
        return json.dumps([min(self.seen, WARMUP + 1), self.span, self.close, [[m.looking, m.top, m.bottom] for m in self.machines], self.waiting])

    @classmethod
    def of(cls, state: str, thetas: tuple[float, ...] = THETAS) -> Lattice:
        seen, span, close, machines, waiting = json.loads(state)
        return cls(thetas, seen=seen, span=span, close=close, machines=[Machine(t, *m) for t, m in zip(thetas, machines, strict=True)], waiting=waiting)

    def feed(self, high: float, low: float, close: float, start: int, at: int | None = None) -> list[tuple]:
        """The turning points that this bar confirms: (scale, bar, price, kind, known at, first).

        start: the warm-up's end; at: the bar's number, by default how many came before it.
        """
        i = self.seen
        at = i if at is None else at
        reach = high - low if self.close is None else max(high - low, abs(high - self.close), abs(low - self.close))
        a = 1 / self.period
        self.span = reach if self.close is None else self.span * (1 - a) + reach * a
        self.seen, self.close = i + 1, close
        if i < start:
            return []
        if i == start:
            self.machines[0].seed(high, low, at, self.span)
            return []
        out, found, scale = [], self.machines[0].feed(high, low, at, self.span), 0
        while found:
            bar, price, kind, first, span = found
            out.append((scale, bar, price, kind, at, first))
            scale += 1
            found = self._coarser(scale, bar, price, span, at, out) if scale < len(self.machines) else None
        return out

    def _coarser(self, scale: int, bar: int, price: float, span: float, known: int, out: list[tuple]) -> tuple | None:
        """A scale's machine starts with its second observation, by which the first is judged too."""
        machine = self.machines[scale]
        if not machine.seeded:
            if not self.waiting[scale]:
                self.waiting[scale] = [price, bar, span, known]
                return None
            p, b, s, k = self.waiting[scale]
            self.waiting[scale] = []
            machine.seed(p, p, b, s)
            # on its own the first confirms only where the range is 0
            if early := machine.feed(p, p, b, s):
                self._emit(scale, early, k, out)
        return machine.feed(price, price, bar, span)

    def _emit(self, scale: int, found: tuple, known: int, out: list[tuple]) -> None:
        bar, price, kind, first, span = found
        out.append((scale, bar, price, kind, known, first))
        if scale + 1 < len(self.machines) and (more := self._coarser(scale + 1, bar, price, span, known, out)):
            self._emit(scale + 1, more, known, out)


def start_of(n: int) -> int:
    """The first bar that turning points are looked for from; n bars in all."""
    return min(WARMUP, max(n - 2, 0))


def turning_points(high: list[float], low: list[float], close: list[float], thetas: tuple[float, ...] = THETAS) -> list[tuple]:
    """All turning points of a series, by scale and order of confirmation."""
    n = len(high)
    if n - start_of(n) < 2:
        return []
    lattice, start, out = Lattice(thetas), start_of(n), []
    for h, lo, c in zip(high, low, close, strict=True):
        out += lattice.feed(h, lo, c, start)
    return sorted(out, key=lambda p: p[0])


def smoothed(values: list[float], alpha: float) -> list[float]:
    """Exponential smoothing that starts with the first value."""
    out: list[float] = []
    for v in values:
        out.append(v if not out else out[-1] * (1 - alpha) + v * alpha)
    return out
