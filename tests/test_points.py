"""The kernel, its invariants, and that nothing is known before it can be."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.functions import indicators
from tidemark.operators import kernel, labeling, lattice, signals
from tidemark.plans.frames import query
from tidemark.streaming import points

COLUMNS = "source string, symbol string, timeframe string, bar_idx int, ts_sec bigint, open double, high double, low double, close double, volume double"


def series(n: int = 1500, seed: int = 1):
    """A geometric walk whose drift changes every few dozen bars, with gaps between bars and fat tails."""
    rng = np.random.default_rng(seed)
    drift = np.repeat(rng.normal(0, 0.004, n), rng.integers(20, 90, n))[:n]
    close = 50 * np.exp(np.cumsum(drift + 0.007 * rng.standard_t(4, n)))
    open_ = np.roll(close, 1) * np.exp(rng.normal(0, 0.002, n))
    open_[0] = close[0]
    up, down = np.exp(rng.gamma(2, 0.003, (2, n)))
    return open_, np.maximum(open_, close) * up, np.minimum(open_, close) / down, close, rng.lognormal(3, 1, n)


def frame(spark, data, symbol="S"):
    rows = [("t", symbol, "1d", i, 1_420_070_400 + 86_400 * i, *map(float, x)) for i, x in enumerate(zip(*data, strict=True))]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, series()).persist()


@pytest.fixture(scope="module")
def pivots(bars):
    return lattice.build(bars).persist()


def test_invariants(pivots, bars):
    assert lattice.violations(pivots.filter("not is_anchor")).filter("breach <> 'nesting'").count() == 0
    counts = [r.n for r in lattice.summary(pivots).orderBy("scale").collect()]
    assert counts == sorted(counts, reverse=True) and len(counts) >= 6
    at = pivots.join(bars, (pivots.idx == bars.bar_idx))
    assert at.filter("price <> case when kind = 1 then high else low end").count() == 0
    assert pivots.filter("confirmed_idx < 14").count() == 0 and pivots.filter("is_anchor and seq > 0").count() == 0


@pytest.mark.parametrize("cut", [600, 900, 1200])
def test_a_prefix_gives_what_was_known_then(spark, bars, pivots, cut):
    key = ["scale", "idx", "price", "kind", "confirmed_idx", "is_anchor"]
    early = {tuple(r) for r in lattice.build(bars.filter(f"bar_idx <= {cut}")).select(*key).collect()}
    known = {tuple(r) for r in pivots.filter(f"confirmed_idx <= {cut}").select(*key).collect()}
    assert early == known
    prefix = lattice.build(bars.filter(f"bar_idx <= {cut}"))
    select = lambda df: {tuple(r) for r in df.select("scale", "seq", "pattern", "start_idx", "end_idx", "known_idx").collect()}
    assert select(labeling.labelings_at(prefix, cut)) == select(labeling.labelings_at(pivots, cut))


def test_signals_and_guidelines_look_only_back(spark, bars, pivots):
    cut = 1100
    ind = indicators.smoothed(bars).persist()
    every = {tuple(r) for r in signals.guidelines(ind, pivots).filter(f"bar <= {cut}").collect()}
    short = bars.filter(f"bar_idx <= {cut}")
    assert {tuple(r) for r in signals.guidelines(indicators.smoothed(short), lattice.build(short)).collect()} == every and every


def test_rising_and_tiny_series():
    up = np.linspace(100, 300, 300)
    found = kernel.turning_points((up + 0.5).tolist(), (up - 0.5).tolist(), up.tolist())
    assert all(p[-1] for p in found)
    assert kernel.turning_points([1.1], [0.9], [1.0]) == []
    flat = [5.0] * 60
    assert len(kernel.turning_points(flat, flat, flat)) > 0  # no range at all: a point at nearly every bar


def test_smoothing():
    assert kernel.smoothed([1.0, 2.0, 3.0], 0.5) == [1.0, 1.5, 2.25]


@pytest.mark.parametrize("bits", [2, 8])
def test_smoothing_by_blocks_is_that_of_the_whole(spark, bits, monkeypatch):
    monkeypatch.setattr(indicators, "SMOOTH_BITS", bits)
    rows = series(700, 11)
    got = indicators.smoothed(frame(spark, rows)).orderBy("bar_idx").collect()
    close = [r.close for r in got]
    moves = [b - a for a, b in zip(close, close[1:], strict=False)]
    up, down = (kernel.smoothed([max(s * m, 0.0) for m in moves], 1 / 14) for s in (1, -1))
    assert [r.rsi for r in got] == pytest.approx([50.0] + [50.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down, strict=True)], rel=1e-9)
    line = [a - b for a, b in zip(kernel.smoothed(close, 2 / 13), kernel.smoothed(close, 2 / 27), strict=True)]
    assert [r.macd for r in got] == pytest.approx(line, abs=1e-9) and [r.macd_signal for r in got] == pytest.approx(kernel.smoothed(line, 0.2), abs=1e-9)
    rising = indicators.smoothed(frame(spark, (np.arange(1.0, 40.0),) * 5)).collect()
    assert {r.rsi for r in rising} == {50.0}


def test_stream_gives_what_the_batch_gives(spark, bars, pivots):
    key = ["scale", "idx", "price", "kind", "confirmed_idx", "is_anchor"]
    got = points.replayed(bars, 3)
    assert {tuple(r) for r in got.select(*key).collect()} == {tuple(r) for r in pivots.select(*key).collect()}


def test_hypotheses_are_causal(pivots):
    for bar in (500, 900):
        rows = labeling.hypotheses(pivots, bar).collect()
        assert rows and {r.next_wave for r in rows} <= {3, 5}
        assert labeling.labelings_at(pivots, bar).filter(f"known_idx > {bar}").count() == 0


def test_frames_of_several_series_do_not_mix(spark):
    a, b = frame(spark, series(300, 2), "A"), frame(spark, series(300, 3), "B")
    both = lattice.build(a.unionByName(b))
    for one, symbol in ((a, "A"), (b, "B")):
        assert {tuple(r) for r in both.filter(f"symbol = '{symbol}'").collect()} == {tuple(r) for r in lattice.build(one).collect()}
    assert query("SELECT count(DISTINCT symbol) AS n FROM {p}", p=both).first().n == 2


def whole(data) -> set:
    """Points of one series by the kernel alone, numbered by scale."""
    seen, out = {}, set()
    for scale, *point in kernel.turning_points(*(data[c].tolist() for c in (1, 2, 3))):
        seen[scale] = seen.get(scale, -1) + 1
        out.add((scale, seen[scale], *point))
    return out


def calm_after_a_shock(n: int = 600):
    """A wide bar, then hardly any movement: the coarse scales' extreme stays far behind, over many blocks."""
    close = 50 + 0.01 * np.sin(np.arange(n) / 3)
    close[40:44] = 80.0
    return close, close + 0.02, close - 0.02, close, np.ones(n)


@pytest.mark.parametrize("bits", [4, 5, 7])
def test_blocks_give_the_points_of_the_whole(spark, bits):
    flat = (np.full(200, 5.0),) * 5
    kinds = {"walk": series(1000, 21), "calm": calm_after_a_shock(), "flat": flat, "rising": (np.arange(1.0, 400.0),) * 5, "short": series(15, 22), "two": series(2, 23), "one": series(1, 24)}
    from functools import reduce

    every = reduce(lambda a, b: a.unionByName(b), (frame(spark, data, name) for name, data in kinds.items())).repartition(3)
    got = {name: set() for name in kinds}
    rows = lattice.build(every, bits).collect()
    for r in rows:
        got[r.symbol].add(tuple(r)[3:])
    assert len(rows) == sum(map(len, got.values()))
    for name, data in kinds.items():
        assert got[name] == whole(data), name


def test_a_series_without_a_name_and_an_empty_table(spark):
    data = series(100, 25)
    named = frame(spark, data).selectExpr("cast(null as string) AS source", "* except (source)")
    assert {tuple(r)[3:] for r in lattice.build(named, 4).collect()} == whole(data)
    assert lattice.build(named.limit(0), 4).collect() == []


def test_states_do_not_grow(spark):
    lattice_, sizes = kernel.Lattice(), []
    for high, low, close in zip(*(series(3000, 26)[c].tolist() for c in (1, 2, 3)), strict=True):
        lattice_.feed(high, low, close, kernel.WARMUP)
        sizes.append(len(lattice_.state()))
    assert max(sizes[1500:]) < 1200
    again = kernel.Lattice.of(lattice_.state())
    assert again.state() == lattice_.state()
