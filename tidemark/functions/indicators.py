"""Indicators. Those over a fixed window are SQL; the exponential ones are linear recurrences, composed over blocks of bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import kernel
from tidemark.plans.frames import BY_BAR, KEY, query
from tidemark.sources.bars import SERIES

_COLUMNS = "source string, symbol string, timeframe string, bar_idx int, ts_sec bigint, open double, high double, low double, close double, volume double"


def rsi(close: list[float], period: int = 14) -> list[float]:
    """Wilder's: 50 on the first bar, and while there has been no loss."""
    moves = [b - a for a, b in zip(close, close[1:], strict=False)]
    gains, losses = (kernel.smoothed(x, 1 / period) for x in ([max(m, 0.0) for m in moves], [max(-m, 0.0) for m in moves]))
    return ([50.0] if close else []) + [50.0 if lo == 0 else 100 - 100 / (1 + g / lo) for g, lo in zip(gains, losses, strict=True)]


def macd(close: list[float], fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[list[float], list[float], list[float]]:
    line = [a - b for a, b in zip(kernel.smoothed(close, 2 / (fast + 1)), kernel.smoothed(close, 2 / (slow + 1)), strict=True)]
    smooth = kernel.smoothed(line, 2 / (signal + 1))
    return line, smooth, [a - b for a, b in zip(line, smooth, strict=True)]


#: Bars in a block of the smoothing, as a power of two; what a value still weighs after so many blocks is below the smallest double.
SMOOTH_BITS, _NOTHING = 8, 700.0


def _carried(added: Column, kept: float) -> Column:
    """What the blocks before a block leave for it: a fold over the last ones, as many as still weigh anything."""
    block = kept ** (1 << SMOOTH_BITS)
    back = math.ceil(_NOTHING / (-math.log(kept) * (1 << SMOOTH_BITS))) + 1
    before = F.collect_list(added).over(Window.partitionBy(*SERIES).orderBy("block").rowsBetween(-back, -1))
    return F.aggregate(before, F.lit(0.0), lambda left, x: left * F.lit(block) + x)


def ema(rows: DataFrame, columns: dict[str, tuple[str, float, int]]) -> DataFrame:
    """rows (SERIES, bar_idx) with columns smoothed exponentially. columns: new name -> (column, alpha, the bar that seeds it).

    y = (1 - alpha) * y + alpha * x is linear, so a block of bars is a pair (what it leaves of the value before it, what it adds). What
    blocks add is summed per block, the pairs are composed over blocks, and within a block the rest is a running sum of
    x / (1 - alpha)^place. No task holds a series: bars meet by series and block, and of blocks there is one row each.
    """
    size, keys = 1 << SMOOTH_BITS, [*SERIES, "block"]
    place = F.col("bar_idx") % size
    rows = rows.withColumn("block", F.shiftright("bar_idx", SMOOTH_BITS))
    weighed = {n: F.when(F.col("bar_idx") < first, 0.0).when(F.col("bar_idx") == first, F.col(x)).otherwise(F.lit(a) * F.col(x)) for n, (x, a, first) in columns.items()}
    kept = {n: 1 - a for n, (_, a, _) in columns.items()}
    sums = rows.groupBy(*keys).agg(*[F.sum(weighed[n] * F.pow(F.lit(q), F.lit(size - 1) - place)).alias(f"add_{n}") for n, q in kept.items()])
    carried = [_carried(F.col(f"add_{n}"), q).alias(f"from_{n}") for n, q in kept.items()]
    running = Window.partitionBy(*keys).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(sums.select(*keys, *carried), keys)
    new = {n: F.sum(weighed[n] * F.pow(F.lit(q), -place)).over(running) * F.pow(F.lit(q), place) + F.col(f"from_{n}") * F.pow(F.lit(q), place + 1) for n, q in kept.items()}
    return out.withColumns(new).drop("block", *[f"from_{n}" for n in kept])


def smoothed(bars: DataFrame, rsi_period: int = 14, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """bars with atr (Wilder's), rsi, macd, macd_signal, macd_hist.

    RSI is 50 on the first bar and while there has been no loss.
    """
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    w = Window.partitionBy(*SERIES).orderBy("bar_idx")
    move = F.col("close") - F.lag("close").over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.lag("close").over(w)), F.abs(F.col("low") - F.lag("close").over(w)))
    rows = bars.select(*names, reach.alias("reach"), F.greatest(move, F.lit(0.0)).alias("gain"), F.greatest(-move, F.lit(0.0)).alias("loss"))
    first_loss = rows.filter("loss > 0").groupBy(*SERIES).agg(F.min("bar_idx").alias("first_loss"))
    wilder = 1 / rsi_period
    once = ema(rows, {"atr": ("reach", 1 / kernel.PERIOD, 0), "g": ("gain", wilder, 1), "lo": ("loss", wilder, 1), "quick": ("close", 2 / (fast + 1), 0), "steady": ("close", 2 / (slow + 1), 0)})
    once = once.join(first_loss, SERIES, "left").withColumn("macd", F.col("quick") - F.col("steady"))
    twice = ema(once, {"macd_signal": ("macd", 2 / (signal + 1), 0)})
    rsi_ = F.when(F.coalesce(F.col("bar_idx") < F.col("first_loss"), F.lit(True)), 50.0).when(F.col("lo") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("g") / F.col("lo")))
    return twice.select(*names, "atr", rsi_.alias("rsi"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))


def _rows(n: int) -> str:
    return f"({BY_BAR} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(what: str, n: int, least: int | None = None) -> str:
    """An aggregate over the last n bars, null while there are fewer than least."""
    arg = what[what.index("(") + 1 : -1]
    return f"(CASE WHEN count({arg}) OVER {_rows(n)} >= {least or n} THEN {what} OVER {_rows(n)} END)"


TRUE_RANGE = f"SELECT {KEY}, bar_idx, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range FROM (SELECT *, lag(close) OVER ({BY_BAR}) AS pc FROM {{bars}}) b"
LOG_RETURNS = f"SELECT {KEY}, bar_idx, " + ", ".join(f"round(ln(close / nullif(lag(close, {n}) OVER ({BY_BAR}), 0)), 9) AS ret_{n}" for n in (5, 20, 60, 120)) + " FROM {bars}"
ROLLING = f"SELECT {KEY}, bar_idx, round({rolling('avg(close)', 50, 10)}, 8) AS mean_50, {rolling('max(high)', 60, 10)} AS max_60, {rolling('min(low)', 60, 10)} AS min_60, round({rolling('avg(volume)', 20, 5)}, 8) AS volume_20 FROM {{bars}}"


def linreg(y: str, n: int) -> str:
    """The value at the last of n bars of the line fitted to them."""
    x = "cast(bar_idx as double)"
    return f"(CASE WHEN count({y}) OVER {_rows(n)} >= {n} THEN regr_intercept({y}, {x}) OVER {_rows(n)} + regr_slope({y}, {x}) OVER {_rows(n)} * {x} END)"


LINREG = f"SELECT {KEY}, bar_idx, round({linreg('close', 20)}, 4) AS linreg_20 FROM {{bars}}"

#: Bollinger bands strictly inside Keltner channels; momentum is the end of a line fitted to the close's distance from the middle.
SQUEEZE = f"""
SELECT {KEY}, bar_idx, coalesce(mid + 2 * sd < mid + 1.5 * tr20 AND mid - 2 * sd > mid - 1.5 * tr20, false) AS squeeze_on,
       coalesce(mid + 2 * sd > mid + 1.5 * tr20 AND mid - 2 * sd < mid - 1.5 * tr20, false) AS squeeze_off, round({linreg('away', 20)}, 4) AS momentum
FROM (SELECT *, close - ((hh + ll) / 2 + mid) / 2 AS away FROM (
  SELECT *, {rolling('avg(close)', 20)} AS mid, {rolling('stddev_pop(close)', 20)} AS sd, {rolling('avg(tr)', 20)} AS tr20, {rolling('max(high)', 20)} AS hh, {rolling('min(low)', 20)} AS ll
  FROM (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER ({BY_BAR}) AS pc FROM {{bars}}) a) b) c) d"""

ATR = f"SELECT {KEY}, bar_idx, round(atr, 4) AS atr FROM {{ind}}"
RSI = f"SELECT {KEY}, bar_idx, round(rsi, 5) AS rsi FROM {{ind}}"
MACD = f"SELECT {KEY}, bar_idx, round(macd, 3) AS macd, round(macd_signal, 3) AS macd_signal, round(macd_hist, 3) AS macd_hist FROM {{ind}}"


def true_range(bars: DataFrame) -> DataFrame:
    return query(TRUE_RANGE, bars=bars)


def squeeze(bars: DataFrame) -> DataFrame:
    return query(SQUEEZE, bars=bars)
