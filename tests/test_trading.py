"""Execution, zones, bars and the catalogue on small fixtures worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import execution, integrity, ratios, risk, zones
from tidemark.plans.frames import query, scattered
from tidemark.sources import bars as sources
from tidemark.sources import catalog

COLUMNS = "source string, symbol string, timeframe string, bar_idx int, ts_sec bigint, open double, high double, low double, close double, volume double"
SIGNAL = "source string, symbol string, timeframe string, bar int, direction int, context_scale int, trigger_scale int, stop double"
ORDER = "source string, symbol string, timeframe string, bar int, direction int, context_scale int, p0 double, p1 double, limit_price double, stop double, target double, extended boolean, expiry_bar int, n_supporting int"


def table(spark, rows, timeframe="1d", step=86_400):
    return spark.createDataFrame([("t", "S", timeframe, i, i * step, *map(float, r), 1.0) for i, r in enumerate(rows)], COLUMNS)


def trade(spark, rows, direction=1, stop=90.0, policy=execution.Policy(per_side=0.0)):
    signal = spark.createDataFrame([("t", "S", "1d", 0, direction, 4, 2, stop)], SIGNAL)
    return query(execution.candidates_sql("{signals}", policy), bars=table(spark, rows), signals=signal).collect()


START = [(100, 100, 100, 100)]


def test_stop_beats_target_within_a_bar(spark):
    (t,) = trade(spark, [*START, (100, 131, 89, 100)])
    assert (t.reason, t.exit, t.r) == ("stop", 90.0, -1.0)


def test_breakeven_counts_from_the_next_bar(spark):
    (t,) = trade(spark, [*START, (100, 111, 99, 110), (110, 112, 100, 101), (101, 140, 100, 130)])
    assert (t.reason, t.exit_bar, t.r) == ("breakeven", 2, 0.0)
    (t,) = trade(spark, [*START, (100, 111, 101, 110), (110, 131, 105, 131)])
    assert (t.reason, t.r) == ("target", 3.0)


def test_time_stop_and_stale_entries(spark):
    (t,) = trade(spark, [*START, (100, 105, 95, 101), (101, 105, 95, 104)])
    assert (t.reason, t.exit, t.exit_bar) == ("time_stop", 104.0, 2)
    assert trade(spark, [*START, (89, 95, 88, 90)]) == [] and trade(spark, START) == []


def test_one_position_at_a_time(spark):
    rows = [("t", "S", "1d", b, 4, 2, 1, e, x, 1.0, 1.0, 1.0, "stop", 0.0) for b, e, x in ((0, 1, 5), (4, 5, 9), (5, 6, 7))]
    schema = "source string, symbol string, timeframe string, bar int, context_scale int, trigger_scale int, direction int, entry_bar int, exit_bar int, entry double, exit double, stop double, reason string, r double"
    assert sorted(r.bar for r in execution.one_at_a_time(spark.createDataFrame(rows, schema)).collect()) == [0, 5]


def order(spark, rows, expiry=10, limit=95.0, **options):
    orders = spark.createDataFrame([("t", "S", "1d", 0, 1, 4, 80.0, 100.0, limit, 90.0, 120.0, False, expiry, 0)], ORDER)
    (r,) = query(zones.fates_sql("SELECT * FROM {orders}", per_side=0.0, **options), bars=table(spark, rows), orders=orders).collect()
    return r


def test_limit_orders(spark):
    assert order(spark, [*START, (100, 120, 94, 100)]).status == "missed"  # missed comes before the touch
    assert order(spark, [*START, (100, 101, 99, 100), (100, 101, 94, 95)], expiry=1).status == "expired"
    gap = order(spark, [*START, (85, 86, 84, 85)])
    assert (gap.entry, gap.exit, gap.reason) == (85.0, 90.0, "stop") and gap.r > 0
    gap = order(spark, [*START, (85, 86, 84, 85)], gap_stop_at_open=True)
    assert (gap.entry, gap.exit, gap.reason, gap.r) == (85.0, 85.0, "stop", 0.0)
    later = [*START, (100, 101, 94, 96), (88, 89, 87, 88)]
    assert [order(spark, later, gap_stop_at_open=g).exit for g in (False, True)] == [90.0, 88.0]
    within = [*START, (100, 101, 94, 96), (96, 97, 89, 91)]
    assert order(spark, within, gap_stop_at_open=True).exit == 90.0
    filled = order(spark, [*START, (100, 101, 94, 96), (96, 121, 95, 110)])
    # a bar beyond the target after the fill
    assert (filled.status, filled.entry, filled.reason, filled.exit) == ("filled", 95.0, "target", 120.0)
    assert order(spark, [*START, (100, 101, 94, 96)]).reason == "open"


def test_metrics_of_three_trades(spark):
    rows = [("t", "S", "1d", i, 4, 2, 1, i + 1, i + 2, 1.0, 1.0, 1.0, "stop", r) for i, r in enumerate((1.0, -1.0, 2.0))]
    schema = "source string, symbol string, timeframe string, bar int, context_scale int, trigger_scale int, direction int, entry_bar int, exit_bar int, entry double, exit double, stop double, reason string, r double"
    m = execution.metrics(spark.createDataFrame(rows, schema), table(spark, [(1, 1, 1, 1)] * 6)).first()
    assert (m.n, m.expectancy, m.total_r, m.max_dd_r) == (3, pytest.approx(2 / 3, abs=1e-5), 2.0, 1.0)
    assert m.win_rate == pytest.approx(2 / 3, abs=1e-5) and m.avg_loss == -1.0 and m.deflated_sharpe is None


def test_cleaning(spark):
    raw = spark.createDataFrame(
        [("t", "S", "1d", 1, 0, 1.0, 2.0, 0.5, 1.5, None), ("t", "S", "1d", 2, 86_400, 1.0, 2.0, 0.5, 1.5, 3.0), ("t", "S", "1d", 3, 86_400, 1.0, 2.0, 0.5, None, 3.0), ("t", "S", "1d", 4, 172_800, 1.0, 2.0, 0.5, float("nan"), 3.0)],
        "source string, symbol string, timeframe string, ingest_seq int, ts_sec bigint, Open double, High double, Low double, `Adj Close` double, Volume double",
    )
    (row,) = sources.normalized(raw).collect()
    assert (row.ts_sec, row.close, row.volume, row.bar_idx) == (0, 1.5, 0.0, 0)
    with pytest.raises(ValueError, match="missing"):
        sources.normalized(raw.drop("High"))
    with pytest.raises(ValueError, match="unknown timeframe"):
        sources.seconds("3m")


def test_resampling_leaves_holes_and_open_bars_out(spark):
    hours = table(spark, [(1, 2, 1, 2), (2, 3, 2, 3)], "1h", 3_600).unionByName(table(spark, [(5, 6, 5, 6)], "1h", 3_600).selectExpr("source", "symbol", "timeframe", "2 as bar_idx", "cast(36000 as bigint) as ts_sec", "open", "high", "low", "close", "volume"))
    rows = sources.resample(hours, "4h").orderBy("ts_sec").collect()
    assert [(r.ts_sec, r.open, r.high, r.low, r.close, r.volume) for r in rows] == [(0, 1.0, 3.0, 1.0, 3.0, 2.0), (28_800, 5.0, 6.0, 5.0, 6.0, 1.0)]
    assert sources.resample(hours, "4h", as_of=40_000).count() == 1


def test_integrity(spark):
    rows = [(100, 101, 99, 100), (100, 99.5, 99, 100), *[(100, 100, 100, 100)] * 6, (50, 51, 49, 50), (50, 51, -1, 50)]
    raw = table(spark, rows).selectExpr("*", "bar_idx as ingest_seq")
    found = {r.code: r.n for r in integrity.issues(raw).collect()}
    assert found == {"OHLC_INCONSISTENT": 1, "FLATLINE": 6, "POSSIBLE_SPLIT": 1, "NONPOSITIVE_PRICE": 1}
    assert not integrity.verdict(raw).first().ok


def test_store_round_trip(spark, tmp_path):
    bars = table(spark, [(1, 2, 0.5, 1.5)] * 3).selectExpr("source", "'A/B=F' as symbol", "timeframe", "bar_idx", "ts_sec", "open", "high", "low", "close", "volume")
    catalog.save(bars, str(tmp_path / "ohlcv"))
    catalog.save(bars, str(tmp_path / "ohlcv"))
    assert catalog.load(spark, str(tmp_path / "ohlcv"), "t", "A/B=F", "1d").count() == 3
    with pytest.raises(FileNotFoundError):
        catalog.load(spark, str(tmp_path / "ohlcv"), "t", "other", "1d")
    hashes = [catalog.content_hash(b).first().hash for b in (bars, bars.withColumn("close", bars.close + 1e-9))]
    assert len(set(hashes)) == 2 and len(hashes[0]) == 16
    entries = spark.createDataFrame([("t", "S", "1d", 5, 1), ("t", "S", "1d", 7, 2)], "source string, symbol string, timeframe string, n_bars int, fetched_at int")
    assert catalog.upsert(entries.limit(0), entries).first().n_bars == 7


def test_small_figures(spark):
    assert spark.sql(ratios.coverage_sql(0.9, 1.2)).first().coverage > 0
    assert risk.no_edge(risk.Rules(target=0.10, drawdown=0.05)) == pytest.approx(1 / 3)
    state = "(SELECT 0 AS n_open, 0e0 AS heat, 0e0 AS cluster_heat, 3 AS losses, 0.8e0 AS drawdown_used)"
    assert spark.sql(risk.allowance_sql(state)).first().allowed == pytest.approx(0.0025)
    with pytest.raises(ValueError, match="too few"):
        risk.challenge(spark, [1.0] * 19, risk.Rules(), [0.01], 1.0)
    out = risk.challenge(spark, [1.0] * 20, risk.Rules(), [0.01, 0.05], 2.0, n_paths=50).collect()
    assert all(r.p_pass == 1.0 for r in out)
    found = risk.results(spark.createDataFrame([(1.0,), (1.0,), (float("nan"),), (None,), (-0.5,)], "r double")).collect()
    assert [tuple(x) for x in found] == [(-0.5, 1), (1.0, 2)]
    drawn = risk.challenge(spark, [-0.5, 1.0], risk.Rules(), [0.02], 1.0, n_paths=400, counts=[10, 30]).first()
    plain = risk.challenge(spark, [-0.5] * 10 + [1.0] * 30, risk.Rules(), [0.02], 1.0, n_paths=400).first()
    assert drawn == plain and 0 < drawn.p_pass <= 1
    assert execution.expected_max(1) == 0.0 and 1.5 < execution.expected_max(10) < 1.7


def test_clusters(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.7)], "symbol_a string, symbol_b string, rho double")
    named = pairs.selectExpr("'x' AS source_a", "symbol_a", "'x' AS source_b", "symbol_b", "'1d' AS timeframe", "rho")
    # c goes with b, but b leads nothing
    assert {r.symbol: r.leader_symbol for r in risk.clusters(named).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_clusters_against_a_loop(spark):
    rng = np.random.default_rng(4)
    names = [(s, f"{i:02}") for s in "xy" for i in range(12)]
    rho = {(a, b): float(rng.uniform(-1, 1)) for i, a in enumerate(names) for b in names[i + 1 :]}
    pairs = spark.createDataFrame([(*a, *b, "1d", r) for (a, b), r in rho.items()], "source_a string, symbol_a string, source_b string, symbol_b string, timeframe string, rho double")
    leaders, want = [], {}
    for s in names:
        want[s] = next((x for x in leaders if rho[x, s] >= 0.5), s)
        leaders += [s] if want[s] == s else []
    got = {(r.source, r.symbol): (r.leader_source, r.leader_symbol) for r in risk.clusters(pairs, 0.5).collect()}
    assert got == want and len(leaders) > 3


def test_paths_against_a_loop():
    """Outcomes by arrays are those of playing result by result."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        rules = risk.Rules(target=rng.choice([0.03, 0.1]), drawdown=rng.choice([0.04, 0.1]), daily=rng.choice([0.02, 0.05]), days=6)
        days = np.sort(rng.integers(1, 7, rng.integers(0, 30)))
        results = np.where(rng.random(len(days)) < 0.4, 2.0, -1.0)
        curve = top = 1.0
        want, day_of, opened = ("open", 6), None, 1.0
        for x, day in zip(results, days, strict=True):
            if day != day_of:
                day_of, opened = day, curve
            curve *= 1 + 0.01 * x
            top = max(top, curve)
            ended = [n for n, hit in (("drawdown", curve <= top * (1 - rules.drawdown)), ("daily", curve <= opened * (1 - rules.daily)), ("pass", curve >= 1 + rules.target)) if hit]
            if ended:
                want = ended[0], int(day)
                break
        assert risk.outcome(results, days, 0.01, rules) == want


def test_correlations_by_blocks_are_those_of_all_bars(spark, monkeypatch):
    from tidemark.plans.frames import query as run

    monkeypatch.setattr(risk, "MOMENT_BITS", 3)
    rng = np.random.default_rng(6)
    rows = [("t", s, "1d", i, 86_400 * (i + lag), 1.0, 1.0, 1.0, float(np.exp(rng.normal())), 1.0) for s, n, lag in (("a", 90, 0), ("b", 70, 3), ("c", 2, 0), ("d", 60, 500)) for i in range(n)]
    bars = spark.createDataFrame(rows, "source string, symbol string, timeframe string, bar_idx int, ts_sec bigint, open double, high double, low double, close double, volume double")
    for align in ("tail", "ts"):
        want = {tuple(r)[:6]: r.rho for r in run(risk.correlations_sql(align), bars=bars).collect()}
        got = {tuple(r)[:6]: r.rho for r in risk.correlations(bars, align).collect()}
        assert set(got) == set(want) and all((want[k] is None or want[k] != want[k]) and got[k] is None or got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_book(spark):
    rows = [("p", s, c, e, x, r, 0.1) for s, c, e, x, r in (("a", "m", 0, 10, -1.0), ("b", "m", 1, 10, -1.0), ("c", "m", 2, 10, -1.0), ("d", "n", 3, 10, -1.0), ("e", "o", 20, 30, 1.0))]
    schema = "portfolio string, symbol string, cluster string, entry_sec int, exit_sec int, r double, max_drawdown double"
    got = {r.symbol: r.allowed for r in risk.book(spark.createDataFrame(rows, schema)).collect()}
    # the third of a cluster finds it full; after three losses the risk is halved
    assert got == pytest.approx({"a": 0.01, "b": 0.01, "c": 0.0, "d": 0.01, "e": 0.005})


def test_ingest(spark, tmp_path):
    import json

    from tidemark.sources import ingest

    quotes = {"open": [1.0] * 9, "high": [2.0] * 8 + [0.5], "low": [0.5] * 9, "close": [1.5] * 9, "volume": [1] * 9}
    good = {**quotes, "high": [2.0] * 9}
    for symbol, q in (("AAPL", good), ("JPM", quotes)):
        (tmp_path / f"{symbol}.json").write_text(json.dumps({"timestamp": [3_600 * i for i in range(9)], "indicators": {"quote": [q]}}))
    found = ingest.fetch(spark, "yfinance", ["AAPL", "JPM"], "4h", 0, 9 * 3_600, kind="chart", url=f"file://{tmp_path}/{{symbol}}.json")
    assert found.groupBy("symbol").count().collect()[0]["count"] == 2  # the third bar isn't complete
    hourly = ingest.fetch(spark, "yfinance", ["AAPL", "JPM"], "1h", 0, 9 * 3_600, kind="chart", url=f"file://{tmp_path}/{{symbol}}.json")
    report = {r.symbol: r for r in ingest.ingest(hourly, str(tmp_path / "store"), 1).collect()}
    assert report["AAPL"].ok and not report["JPM"].ok and report["AAPL"].cluster == "equity_tech"
    assert catalog.load(spark, str(tmp_path / "store"), "yfinance", "AAPL", "1h").count() == 9
    with pytest.raises(FileNotFoundError):
        catalog.load(spark, str(tmp_path / "store"), "yfinance", "JPM", "1h")


def test_walk_forward_trains_only_on_labels_that_end_before_the_fold(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.operators import features

    seen = []

    class Trees:
        def fit(self, train):
            seen.append(train.agg(F.max("bar_idx"), F.count("*")).first())
            return self

        def transform(self, test):
            return test.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(features, "_trees", lambda *_: Trees())
    rows = [("s", "x", "1h", i, 1, i, i + 121, float(i), float(i)) for i in range(1800)]
    frame = spark.createDataFrame(rows, "source string, symbol string, timeframe string, bar_idx int, direction int, ts_sec bigint, end_sec bigint, f double, label_excess double")
    got = features.walk_forward(frame)
    # folds of 300: the first leaves 179 rows to train on and the second 479, fewer than 500
    assert [tuple(x) for x in seen] == [(300 * k - 122, 300 * k - 121) for k in (3, 4, 5)]
    assert sorted(r.fold for r in got.select("fold").distinct().collect()) == [3, 4, 5]


def test_draws_are_not_shifts_of_each_other(spark):
    place = lambda bar, draw: scattered(f"cast({bar} as bigint) * 7919 + {draw} * 15485863") + " % 5000"
    rows = spark.sql(f"SELECT ({place('id', 0)} - {place('id', 1)} + 5000) % 5000 AS apart, {place('id', 0)} AS at FROM range(1000)").toPandas()
    assert rows.apart.nunique() > 850 and rows["at"].between(0, 4999).all()
    assert rows["at"].value_counts().max() < 8 and 2_200 < rows["at"].mean() < 2_800


def test_surrogates_keep_each_bar_s_shape(spark):
    bars = [(100 + i, 103 + i, 99 + i, 102 + i) for i in range(200)]
    shapes = {round(o / c, 9) for o, _, _, c in bars}
    made = ratios.surrogate(table(spark, bars)).collect()
    assert len(made) == 200 and {round(r.open / r.close, 9) for r in made} <= shapes
    assert all(r.low <= r.open <= r.high for r in made) and round(made[0].open, 6) == 100
