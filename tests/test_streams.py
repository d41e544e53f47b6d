"""Streams as keyed state: cut into batches anywhere, they give what plain loops and the batch operators give."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_points import frame, series
from tidemark.functions import indicators as batch
from tidemark.operators import risk
from tidemark.plans.frames import query
from tidemark.streaming import indicators, replay, waiting


def test_windows_of_a_stream_are_those_of_the_batch(spark):
    """Whatever the cuts; a repeat of bars that came gives nothing."""
    bars = frame(spark, series(320, 5)).unionByName(frame(spark, series(90, 6), "B"))
    got = replay.replayed(bars, indicators.sliding, "bar_idx", [1, 17, 230]).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
    assert len(got) == 410
    for template, names in ((batch.ROLLING, ("mean_50", "max_60", "min_60", "volume_20")), (batch.LINREG, ("linreg_20",)), (batch.SQUEEZE, ("squeeze_on", "squeeze_off", "momentum")), (batch.LOG_RETURNS, ("ret_5", "ret_20", "ret_60", "ret_120"))):
        want = query(template, bars=bars).toPandas().sort_values(["symbol", "bar_idx"]).reset_index(drop=True)
        for name in names:
            assert np.allclose(got[name].astype(float), want[name].astype(float), atol=1e-4 if name in ("linreg_20", "momentum") else 1e-7, equal_nan=True), name


def test_running_windows_against_lists():
    """Long runs of large and small values, taken out of their state and put in again."""
    rng = np.random.default_rng(2)
    values = (rng.normal(0, 1, 3000) * np.where(rng.random(3000) < 0.01, 1e9, 1)).tolist()
    mean, top, line = indicators.Mean(20, 5), indicators.Extreme(20, 1, 5), indicators.Line(20)
    for i, x in enumerate(values):
        last = values[max(0, i - 19) : i + 1]
        scale = max(map(abs, last)) + 1
        assert mean.add(x) == (pytest.approx(sum(last) / len(last), abs=1e-6 * scale) if len(last) >= 5 else None)
        assert top.add(x) == (max(last) if i >= 4 else None)
        end = line.add(x)
        assert end is None if i < 19 else end == pytest.approx(np.polyval(np.polyfit(range(20), last, 1), 19), abs=1e-6 * max(map(abs, values[max(0, i - 40) : i + 1])) + 1e-6)
    own = indicators.Indicators()
    names = [c.split()[0] for c in indicators.STATE.split(", ")]
    other = indicators.Indicators()
    for i in range(400):
        row = (10 + math.sin(i), 9 + math.sin(i), 9.5 + math.sin(i), 1.0)
        a, b = own.add(*row), other.add(*row)
        assert [x if x is None else pytest.approx(x, abs=1e-9) for x in a] == list(b)
        other = indicators.Indicators(**dict(zip(names, other.row(), strict=True)))


def test_hypotheses_and_orders_end(spark):
    kind = "source string, symbol string, timeframe string, ts_sec bigint, bar_idx int, is_bar boolean, high double, low double, id string, direction int, dead double, limit_price double, expiry_bar int, deadline_sec bigint"
    bar = lambda i, h, lo: ("t", "S", "1d", 10_000 + i, i, True, float(h), float(lo), None, None, None, None, None, None)
    new = lambda i, name, d, dead, limit=None, expiry=None, until=None: ("t", "S", "1d", 10_000 + i, i, False, None, None, name, d, float(dead), limit, expiry, until)
    first = [new(0, "up", 1, 90), new(0, "down", -1, 120), new(0, "buy", 1, 130, 95.0, 5), new(0, "late", 1, 130, 50.0, 1), new(0, "silent", 1, 500, 1.0, 99, 10_050), bar(0, 200, 1), bar(1, 110, 100)]
    second = [bar(2, 119, 94), bar(3, 121, 89)]
    clock = [(None, None, None, at, 0, False, *[None] * 8) for at in (20_000, 20_001)]
    rows = spark.createDataFrame(first + second + clock, kind).withColumn("ts", F.timestamp_seconds("ts_sec"))
    for cuts in ([10_002, 20_000, 20_001], [10_001, 10_002, 10_003, 20_000, 20_001]):
        got = {(r.id, r.what, r.bar_idx) for r in replay.replayed(rows, waiting.ends, "ts_sec", cuts).collect()}
        # no bar comes after the fourth, so the silent order ends by its timer
        assert got == {("buy", "filled", 2), ("late", "expired", 2), ("up", "invalid", 3), ("down", "invalid", 3), ("silent", "expired", None)}


def test_a_book_cut_into_batches_allows_what_the_whole_does(spark):
    rng = np.random.default_rng(7)
    rows = [(f"p{i % 2}", f"s{i}", f"c{i % 3}", int(t), int(t + rng.integers(1, 60)), float(rng.normal()), 0.1) for i, t in enumerate(np.sort(rng.integers(0, 900, 160)))]
    trades = spark.createDataFrame(rows, "portfolio string, symbol string, cluster string, entry_sec bigint, exit_sec bigint, r double, max_drawdown double")
    want = {r.symbol: r.allowed for r in risk.book(trades).collect()}
    got = {r.symbol: r.allowed for r in replay.replayed(trades, waiting.book, "entry_sec", [100, 101, 640]).collect()}
    assert got == pytest.approx(want) and len(set(want.values())) > 4
