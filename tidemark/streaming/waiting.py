"""Hypotheses and limit orders that wait on a stream of bars, and a book of positions, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.risk import Account, Limits
from tidemark.sources.bars import SERIES

#: What waits: the price that ends it, an order's limit and the last bar on which it can be filled, the bar it counts from, and when it ends at the latest (epoch milliseconds).
_HELD = "direction int, dead double, limit_price double, expiry_bar int, placed int, deadline bigint"
ENDS = "source string, symbol string, timeframe string, id string, what string, bar_idx int"
_COLUMNS = ("bar_idx", "is_bar", "high", "low", "id", "direction", "dead", "limit_price", "expiry_bar", "deadline_sec")


def end_of(held: tuple, bar_idx: int, high: float, low: float) -> str | None:
    """What a bar makes of something that waits, if it ends it.

    A hypothesis ends at its price or beyond; an order is missed there, even where the bar reaches its limit too, filled at its limit, or it expires.
    """
    d, dead, limit, expiry, placed, _ = held
    if bar_idx <= placed:
        return None
    if expiry is not None and bar_idx > expiry:
        return "expired"
    if limit is None:
        return "invalid" if (low <= dead if d > 0 else high >= dead) else None
    if high >= dead if d > 0 else low <= dead:
        return "missed"
    return "filled" if (low <= limit if d > 0 else high >= limit) else None


def _none(x: Any) -> Any:
    return None if pd.isna(x) else x


class Waiting(StatefulProcessor):
    """A map from identifiers to what waits. A timer of event time ends an order though no bar of its series comes any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getMapState("held", "id string", _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.held.iterator()}
        before, out = dict(held), []
        # a bar is judged before what is placed on it
        for r in pd.concat(list(rows)).sort_values(["bar_idx", "is_bar"], ascending=[True, False], kind="stable").itertuples():
            if r.is_bar:
                ended = [(name, what) for name, h in held.items() if (what := end_of(h, r.bar_idx, r.high, r.low))]
                out += [(*key, name, what, int(r.bar_idx)) for name, what in ended]
                for name, _ in ended:
                    del held[name]
            elif r.id is not None:
                expiry, deadline = _none(r.expiry_bar), _none(r.deadline_sec)
                held[r.id] = (int(r.direction), float(r.dead), _none(r.limit_price), None if expiry is None else int(expiry), int(r.bar_idx), None if deadline is None else int(deadline) * 1000)
        for name in before.keys() - held.keys():
            self.held.removeKey((name,))
        for name in held.keys() - before.keys():
            self.held.updateValue((name,), held[name])
            if held[name][5] is not None:
                self.handle.registerTimer(held[name][5])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ENDS.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        late = [k[0] for k, v in self.held.iterator() if v[5] is not None and v[5] <= now]
        for name in late:
            self.held.removeKey((name,))
        if late:
            yield pd.DataFrame([(*key, name, "expired", None) for name in late], columns=[c.split()[0] for c in ENDS.split(", ")]).astype({"bar_idx": "Int32"})

    def close(self) -> None:
        pass


def ends(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """What becomes of hypotheses and limit orders, bar by bar; what a timer ends has no bar.

    events: source, symbol, timeframe, ts (event time), bar_idx, is_bar, high, low (of bars), id, direction, dead (the price that ends
    it), limit_price (null: a hypothesis), expiry_bar, deadline_sec (epoch seconds; null: waits for ever). An order counts from the bar
    after its own. Rows with neither bar nor id only move the clock. late: how far behind the latest event rows may come.
    """
    timed = events.withWatermark("ts", late).select(*SERIES, "ts", *_COLUMNS)
    return timed.groupBy(*SERIES).transformWithStateInPandas(Waiting(), ENDS, "append", "eventTime")


def events_of(bars: DataFrame, placed: DataFrame, clock: tuple[int, ...] = ()) -> DataFrame:
    """Bars and what is placed on them as one table of events with ts_sec; clock: seconds at which nothing happens but that they pass.

    placed: SERIES, bar, id, direction, dead, limit_price, expiry_bar, deadline_sec, ts_sec.
    """
    of_bars = bars.select(*SERIES, "ts_sec", "bar_idx", F.lit(True).alias("is_bar"), "high", "low")
    own = placed.select(*SERIES, "ts_sec", F.col("bar").cast("int").alias("bar_idx"), F.lit(False).alias("is_bar"), "id", F.col("direction").cast("int").alias("direction"), "dead", "limit_price", F.col("expiry_bar").cast("int").alias("expiry_bar"), "deadline_sec")
    out = of_bars.unionByName(own, allowMissingColumns=True)
    if clock:
        passing = bars.sparkSession.createDataFrame([(s, 0, False) for s in clock], "ts_sec bigint, bar_idx int, is_bar boolean")
        out = out.unionByName(passing, allowMissingColumns=True)
    return out.withColumn("ts", F.timestamp_seconds("ts_sec"))


# ---- a book of positions ----

_TRADE = ("portfolio", "symbol", "cluster", "entry_sec", "exit_sec", "r", "max_drawdown")
ALLOWED = "portfolio string, symbol string, cluster string, entry_sec bigint, exit_sec bigint, r double, allowed double"
_OPEN = "exit_sec bigint, cluster string, risk double, r double"


class Book(StatefulProcessor):
    """Trades of a portfolio come in order of entry over batches; state: the account's figures and its open positions."""

    def __init__(self, limits: Limits = Limits()):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.figures = handle.getValueState("figures", "equity double, peak double, losses int")
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        figures = self.figures.get() if self.figures.exists() else (1.0, 1.0, 0)
        account = Account(self.limits, *figures, [tuple(x) for x in self.open.get()] if self.open.exists() else [])
        out = account.played(pd.concat(list(rows)))
        self.figures.update((account.equity, account.peak, account.losses))
        if account.open:
            self.open.put(account.open)
        else:
            self.open.clear()
        yield out[[c.split()[0] for c in ALLOWED.split(", ")]]

    def close(self) -> None:
        pass


def book(trades: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A stream of trades (portfolio, symbol, cluster, entry_sec, exit_sec, r, max_drawdown) with what each may risk."""
    return trades.select(*_TRADE).groupBy("portfolio").transformWithStateInPandas(Book(limits), ALLOWED, "append", "none")
