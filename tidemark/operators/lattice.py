"""Turning points of many series, and what is asked of them directly."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import kernel
from tidemark.plans.frames import KEY, on, query
from tidemark.sources.bars import SERIES

#: Bars in a block, as a power of two; at least 4, so that a series' first block tells whether it is shorter than the warm-up.
BITS = 12
POINT = ("scale", "idx", "price", "kind", "confirmed_idx", "is_anchor")
_RAN = "source string, symbol string, timeframe string, block int, place int, scale int, idx int, price double, kind int, confirmed_idx int, is_anchor boolean, began string, ended string"
_FED = (*SERIES, "part", "block", "bar_idx", "high", "low", "close", "state")


class _Run:
    """Consecutive blocks of a series, fed bar by bar from a state, or from the series' beginning where there is none."""

    def __init__(self, key: tuple, state: str | None):
        self.key, self.began, self.block = key, state, None
        self.lattice = kernel.Lattice.of(state) if state else kernel.Lattice()
        self.first: list[tuple] | None = None if state else []  # bars held back until it is known how long the warm-up is
        self.counts: Counter[int] = Counter()

    def take(self, block: int, *bar: float) -> list[tuple]:
        out = self._left() if self.block not in (None, block) else []
        self.block = block
        if self.first is None:
            return out + self._points(kernel.WARMUP, bar)
        self.first.append(bar)
        return out + (self._begin() if len(self.first) == kernel.WARMUP + 2 else [])

    def end(self) -> list[tuple]:
        out = self._begin() if self.first else []
        return out + (self._left() if self.block is not None else [])

    def _begin(self) -> list[tuple]:
        held, self.first = self.first, None
        start = kernel.start_of(len(held))
        return [row for bar in held for row in self._points(start, bar)]

    def _points(self, start: int, bar: tuple) -> list[tuple]:
        at, high, low, close = bar
        out = []
        for scale, *point in self.lattice.feed(high, low, close, start, at):
            out.append((*self.key[:3], self.block, self.counts[scale], scale, *point, None, None))
            self.counts[scale] += 1
        return out

    def _left(self) -> list[tuple]:
        """A block's last row: the states in which it began and ended."""
        began, self.began = self.began, self.lattice.state()
        self.counts.clear()
        return [(*self.key[:3], self.block, *[None] * 7, began, self.began)]


def _feed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by series, part and bar; a part's state comes before its bars. Nothing is held but the current state."""
    run = None
    for batch in batches:
        out: list[tuple] = []
        for *key, block, bar, high, low, close, state in batch.itertuples(index=False, name=None):
            if run is None or run.key != tuple(key):
                out += run.end() if run else []
                run = _Run(tuple(key), state)
            if state is None:
                out += run.take(block, bar, high, low, close)
        yield _frame(out)
    if run:
        yield _frame(run.end())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = [c.split()[0] for c in _RAN.split(", ")]
    return pd.DataFrame(rows, columns=columns).astype({c: "Int32" for c in ("place", "scale", "idx", "kind", "confirmed_idx")} | {"is_anchor": "boolean"})


def _run(rows: DataFrame) -> DataFrame:
    """_FED's columns in, each part run by one task."""
    return rows.select(*_FED).repartition(*SERIES, "part").sortWithinPartitions(*SERIES, "part", "bar_idx").mapInPandas(_feed, _RAN)


def _only(rows: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """Rows whose series and part are among some (left_semi) or aren't (left_anti); a null is a name like any other."""
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in (*SERIES, "part")]
    return rows.alias("r").join(parts.alias("p"), same, how)


def build(bars: DataFrame, bits: int = BITS) -> DataFrame:
    """Turning points of every series at all scales. seq counts a scale's points. Bars are numbered from 0 on.

    A series is cut into blocks, which run at the same time: first each as if the series began with it, then each from the
    state in which the block before it ended. A reversal forgets what came before it, so nearly always that state is right
    already. Where it wasn't, the block runs again, together with its neighbours in runs twice as long each time, so that
    log2 of a series' blocks is the most rounds there can be. Once every block has begun as the one before it has ended, the points
    are those of one run over the whole series, to the bit. Bars stream through a run, however long it is.
    """
    from tidemark.plans.base import stored

    bars = bars.select(*SERIES, F.shiftright("bar_idx", bits).alias("block"), F.col("bar_idx").cast("int").alias("bar_idx"), "high", "low", "close")
    rows = bars.withColumn("part", F.col("block")).withColumn("state", F.lit(None).cast("string"))
    ran, width = stored(_run(rows)), 0
    while True:
        blocks = ran.filter("ended IS NOT NULL").select(*SERIES, "block", "began", "ended")
        blocks = query(f"SELECT *, lag(ended) OVER (PARTITION BY {KEY} ORDER BY block) AS before FROM {{blocks}}", blocks=blocks)
        part = F.shiftright("block", width).alias("part")
        wrong = blocks.filter("before IS NOT NULL AND (began IS NULL OR began <> before)")
        again = stored(wrong.select(*SERIES, part).distinct())
        if not again.head(1):
            break
        # a part begins as the block before it has ended; the series' first has no such block
        states = blocks.select(*SERIES, part, "block", "before").groupBy(*SERIES, "part").agg(F.min_by("before", "block").alias("state"))
        states = _only(states.filter("state IS NOT NULL"), again, "left_semi").selectExpr(*SERIES, "part", "-1 AS block", "-1 AS bar_idx", "0D AS high", "0D AS low", "0D AS close", "state")
        more = _only(rows.withColumn("part", part), again, "left_semi").select(*_FED)
        kept = _only(ran.withColumn("part", part), again, "left_anti").select(*ran.columns)
        ran, width = stored(kept.unionByName(_run(more.unionByName(states)))), width + 1
    return query(_NUMBERED, ran=ran)


#: Points numbered over blocks: those of the blocks before come first.
_NUMBERED = f"""
SELECT p.source, p.symbol, p.timeframe, p.scale, cast(p.place + b.before as int) AS seq, p.idx, p.price, p.kind, p.confirmed_idx, p.is_anchor
FROM {{ran}} p JOIN (
  SELECT {KEY}, scale, block, coalesce(sum(count(*)) OVER (PARTITION BY {KEY}, scale ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM {{ran}} WHERE ended IS NULL GROUP BY {KEY}, scale, block) b
ON p.source <=> b.source AND p.symbol <=> b.symbol AND p.timeframe <=> b.timeframe AND b.scale = p.scale AND b.block = p.block
WHERE p.ended IS NULL"""


def visible_at(pivots: DataFrame, bar: int) -> DataFrame:
    """What is known at a bar: points confirmed by then that aren't a scale's first."""
    return pivots.filter(f"confirmed_idx <= {int(bar)} and not is_anchor")


def frame(pivots: DataFrame, bars: DataFrame) -> DataFrame:
    """Points with the times of their bar and of the bar at which they were known."""
    return query(FRAME, pivots=pivots, bars=bars)


def summary(pivots: DataFrame) -> DataFrame:
    """Per series and scale how many points, their median lag and the mean gap between them."""
    return query(SUMMARY, pivots=pivots)


def violations(pivots: DataFrame) -> DataFrame:
    """Breaches of what must hold: nesting in the finer scale, known no earlier than it happened, alternation."""
    return query(VIOLATIONS, pivots=pivots)


def lags(pivots: DataFrame) -> DataFrame:
    """Per series and scale of three points or more: lag and duration (medians), their quotient, move in percent."""
    return query(LAGS, pivots=pivots)


def lags_by_scale(pivots: DataFrame) -> DataFrame:
    """The medians of lags() over all series."""
    return query(LAGS_BY_SCALE, pivots=pivots)


FRAME = f"""
SELECT p.source, p.symbol, p.timeframe, p.scale, p.seq, p.idx, b.ts_sec AS at_sec, p.price, p.kind, p.confirmed_idx, k.ts_sec AS known_sec, p.confirmed_idx - p.idx AS lag_bars
FROM {{pivots}} p JOIN {{bars}} b ON {on("p", "b")} AND b.bar_idx = p.idx JOIN {{bars}} k ON {on("p", "k")} AND k.bar_idx = p.confirmed_idx"""

SUMMARY = f"""
SELECT {KEY}, scale, count(*) AS n, round(median(cast(confirmed_idx - idx as double)), 6) AS median_lag, round(avg(cast(gap as double)), 6) AS mean_gap
FROM (SELECT *, idx - lag(idx) OVER (PARTITION BY {KEY}, scale ORDER BY seq) AS gap FROM {{pivots}}) g GROUP BY {KEY}, scale"""

VIOLATIONS = f"""
SELECT 'nesting' AS breach, p.source, p.symbol, p.timeframe, p.scale, p.idx, p.kind
FROM {{pivots}} p LEFT JOIN {{pivots}} f ON {on("p", "f")} AND f.scale = p.scale - 1 AND f.idx = p.idx AND f.kind = p.kind
WHERE p.scale > 0 AND f.idx IS NULL
UNION ALL
SELECT 'causality', {KEY}, scale, idx, kind FROM {{pivots}} WHERE confirmed_idx < idx
UNION ALL
SELECT 'alternation', {KEY}, scale, idx, kind
FROM (SELECT *, lead(kind) OVER w AS next_kind, lead(idx) OVER w AS next_idx FROM {{pivots}} WHERE NOT is_anchor WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)) a
WHERE next_kind = kind OR next_idx <= idx"""

LAGS = f"""
SELECT {KEY}, scale, count(*) AS n, median(cast(confirmed_idx - idx as double)) AS median_lag, median(cast(duration as double)) AS median_duration,
       round(median(cast(confirmed_idx - idx as double)) / nullif(median(cast(duration as double)), 0), 6) AS quotient, round(median(move), 6) AS median_move_pct
FROM (SELECT *, (lead(idx) OVER w) - idx AS duration, abs((lead(price) OVER w) / nullif(price, 0) - 1) * 100 AS move FROM {{pivots}} WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)) d
GROUP BY {KEY}, scale HAVING count(*) >= 3"""

_THETA = "CASE scale " + " ".join(f"WHEN {i} THEN {x}e0" for i, x in enumerate(kernel.THETAS)) + " END"
LAGS_BY_SCALE = f"""
SELECT scale, {_THETA} AS theta, count(*) AS n_series, median(median_lag) AS median_lag, median(median_duration) AS median_duration, round(median(quotient), 6) AS quotient, round(median(median_move_pct), 6) AS median_move_pct
FROM ({LAGS}) l GROUP BY scale"""
#: Whether a lag is the same part of a move at all scales.
LAG_RANGE = f"""
SELECT count(*) AS n_scales, min(quotient) AS least, max(quotient) AS most, round(median(quotient), 6) AS middle FROM ({LAGS_BY_SCALE}) s"""
