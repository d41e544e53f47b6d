"""Kept frames, as-of joins, first hits and p-values by themselves."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tests.conftest import SF
from tests.test_points import frame, series
from tidemark.functions.student import p_value
from tidemark.operators import hits, lattice, signals, zones
from tidemark.plans import base, frames, registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_frames_are_computed_once(spark):
    """Two queries running read what the first has written, and neither computes it anew."""
    for name in ("metrics_portfolio", "backtest_by_reason", "metrics_portfolio"):
        plan = _plan(registry.queries()[name](spark, SF))
        assert "FlatMapGroups" not in plan and "events.parquet" not in plan and "tidemark-frames" in plan
        assert plan.count("Exchange hashpartitioning") < 20


def test_as_of_joins_have_no_range_alone(spark):
    bars = frame(spark, series(500, 2)).persist()
    points = lattice.build(bars).persist()
    for template, used in ((signals.signals_sql(), {"bars": bars, "pivots": points}), (zones.ORDERS, {"bars": bars, "pivots": points})):
        plan = _plan(frames.query(template, **used))
        assert "CartesianProduct" not in plan and not re.search(r"(confirmed_idx|known|bar)#\d+ (>=|<) (from_bar|to_bar)#", plan)


@pytest.mark.parametrize("bits", [3, 5])
def test_as_of_joins_by_blocks(spark, bits, monkeypatch):
    """Small blocks and one block give the same rows."""
    bars = frame(spark, series(900, 8)).unionByName(frame(spark, series(300, 9), "B"))
    points = lattice.build(bars).persist()
    run = lambda: [sorted(map(tuple, frames.query(t, bars=bars, pivots=points).collect()), key=str) for t in (signals.signals_sql(), zones.ORDERS, zones.DECOMPOSITIONS)]
    want = run()
    monkeypatch.setattr(frames, "AS_OF_BITS", bits)
    monkeypatch.setattr(frames, "BLOCK_BITS", bits)
    got = run()
    assert got == want and all(len(x) > 3 for x in want)


@pytest.mark.parametrize("bits", [(0, 1, 2, 4, 6), (0, 8, 12, 16, 20)])
def test_first_hits_against_a_loop(spark, bits, monkeypatch):
    monkeypatch.setattr(hits, "BITS", bits)
    data, rng = series(700, 3), np.random.default_rng(3)
    bars, rows = frame(spark, data), []
    for i in range(150):
        start = int(rng.integers(0, 700))
        near = float(rng.choice([0.002, 0.05, 0.4, 3.0]))
        rows.append(("t", "S", "1d", i, None if i % 20 == 0 else start, float(data[3][start] * (1 - near)), float(data[3][start] * (1 + near))))
    wanted = spark.createDataFrame(rows, "source string, symbol string, timeframe string, id int, start int, lower double, upper double")
    got = {r.id: r.hit for r in hits.first_hits(wanted, hits.ladder(bars)).collect()}
    _, high, low, _, _ = data
    want = {r[3]: None if r[4] is None else next((k for k in range(r[4], 700) if low[k] <= r[5] or high[k] >= r[6]), None) for r in rows}
    assert got == want and len({v is None for v in want.values()}) == 2


def test_fates_by_descent_are_those_of_all_later_bars(spark):
    bars = frame(spark, series(1500, 4)).persist()
    points = lattice.build(bars).persist()
    for option in (False, True):
        got = zones.fates(bars, points, hits.ladder(bars), gap_stop_at_open=option)
        want = frames.query(zones.fates_sql(zones.ORDERS, gap_stop_at_open=option), bars=bars, pivots=points)
        columns = sorted(want.columns)
        assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect())) and got.count() > 5


#: T, degrees of freedom, two-sided p, as tabled or in closed form.
TABLED = [
    (12.706204736, 1, 0.05), (63.656741162, 1, 0.01), (4.302652730, 2, 0.05), (2.228138852, 10, 0.05), (3.169272673, 10, 0.01), (2.042272456, 30, 0.05), (1.959963985, 1e9, 0.05),
    (1.0, 1, 0.5), (0.0, 7, 1.0), (2 ** 0.5, 2, 1 - 2 ** 0.5 / 2), (1e-4, 1, 1 - 2 / np.pi * np.arctan(1e-4)), (1e6, 1, 1 - 2 / np.pi * np.arctan(1e6)),
]


def test_p_values(spark, duck):
    """Also of degrees of freedom that aren't whole, which Welch's t has, against an integral of the density."""
    text = p_value("t", "nu")
    rows = [(float(t), float(nu), float(p)) for t, nu, p in TABLED if nu < 1e8]
    for t, nu in ((0.3, 3.7), (-1.9, 11.25), (2.6, 240.5), (4.0, 5.5)):
        x = np.linspace(0, abs(t), 400_001)
        density = (1 + x * x / nu) ** (-(nu + 1) / 2)
        tail = np.linspace(0, 1 / abs(t), 400_001)[1:]
        beyond = (1 + 1 / (tail * tail * nu)) ** (-(nu + 1) / 2) / tail**2
        inside, outside = np.trapezoid(density, x), np.trapezoid(np.append(0.0, beyond), np.append(0.0, tail))
        rows.append((t, nu, float(outside / (inside + outside))))
    df = spark.createDataFrame([*rows, (None, 3.0, None), (1.0, 0.0, None), (1.0, None, None)], "t double, nu double, p double")
    got = frames.query(f"SELECT p, {text} AS found FROM {{rows}}", rows=df).collect()
    assert all(r.found == (None if r.p is None else pytest.approx(r.p, abs=2e-9)) for r in got)
    values = ", ".join(f"({t!r}::DOUBLE, {nu!r}::DOUBLE, {p!r}::DOUBLE)" for t, nu, p in rows)
    assert all(b == pytest.approx(a, abs=2e-9) for a, b in duck.execute(f"SELECT p, {frames.plain(text)} FROM (VALUES {values}) AS v(t, nu, p)").fetchall())
