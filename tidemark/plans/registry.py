"""All queries on price series by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import indicators
from tidemark.operators import charts, execution, features, integrity, labeling, lattice, ratios, risk, signals, zones
from tidemark.plans import base, duck
from tidemark.plans.frames import on as plain_on
from tidemark.plans.frames import blocked, plain, query
from tidemark.sources import bars, catalog
from tidemark.streaming import indicators as sliding
from tidemark.streaming import points, replay, waiting

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, template: str, view: str = "walk_h", frames: tuple[str, ...] = ("bars",)) -> None:
    """A query whose Spark form and SQL are one template over frames of a view."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {f: base.frame(spark, sf_dir, f, view) for f in frames if "{" + f + "}" in blocked(template)}
        return query(template, **used) if used else spark.sql(template)

    _QUERIES[name] = run
    _SQL[name] = f"{base.with_sql(view, frames)} SELECT * FROM ({template.format(bars=view, pivots='pivots', ind='ind')}) AS answer"


def _own(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = sql


_P, _BI = ("pivots",), ("bars", "ind")

# ---- bars ----
_COLUMNS = "source, symbol, timeframe, bar_idx, ts_sec, open, high, low, close, volume"
_add("bars_walk_d", f"SELECT {_COLUMNS} FROM {{bars}}", "walk_d")
_add("bars_walk_i", f"SELECT {_COLUMNS} FROM {{bars}}", "walk_i")
_add("bars_resample_1h", f"SELECT {_COLUMNS} FROM {{bars}}", "walk_h")


def _resampled(view: str, timeframe: str, bin_sql: str, as_of: int | None = None) -> tuple:
    run = lambda spark, sf_dir: bars.resample(base.frame(spark, sf_dir, "bars", view), timeframe, as_of)
    late = f" WHERE bin + {bars.SECONDS[timeframe]} <= {as_of}" if as_of else ""
    sql = f"""{base.with_sql(view, ())} SELECT source, symbol, '{timeframe}' AS timeframe, (row_number() OVER (PARTITION BY source, symbol ORDER BY bin) - 1)::INTEGER AS bar_idx, bin::BIGINT AS ts_sec, open, high, low, close, volume
FROM (SELECT source, symbol, {bin_sql} AS bin, arg_min(open, ts_sec) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_sec) AS close, sum(volume) AS volume FROM {view} GROUP BY source, symbol, bin) b{late}"""
    return run, sql


_own("bars_resample_4h_from_1h", *_resampled("walk_h", "4h", "ts_sec // 14400 * 14400"))
_own("bars_resample_weekly", *_resampled("walk_d", "1w", "(ts_sec - 259200) // 604800 * 604800 + 259200"))
_own("bars_drop_incomplete", *_resampled("walk_h", "4h", "ts_sec // 14400 * 14400", 1_706_000_000))


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(integrity.DIRTY, bars=base.frame(spark, sf_dir, "bars", "walk_i"))


_DIRTY_SQL = base.with_sql("walk_i", ()) + f", raw AS ({integrity.DIRTY.format(bars='walk_i')})"
_own(
    "bars_dedupe_keep_last",
    lambda spark, sf_dir: bars.normalized(_dirty(spark, sf_dir)),
    f"""{_DIRTY_SQL} SELECT source, symbol, timeframe, ts_sec, open, high, low, close, coalesce(volume, 0) AS volume, (row_number() OVER (PARTITION BY source, symbol, timeframe ORDER BY ts_sec) - 1)::INTEGER AS bar_idx
FROM (SELECT *, row_number() OVER (PARTITION BY source, symbol, timeframe, ts_sec ORDER BY ingest_seq DESC) AS n FROM raw) r WHERE n = 1 AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""",
)
for _name, _template in (("report", integrity.ISSUES), ("verdict", integrity.VERDICT), ("flatlines", integrity.FLATLINES), ("gaps_top3", integrity.WORST_GAPS), ("splits", integrity.SPLIT_DAYS), ("examples", integrity.EXAMPLES)):
    _own(f"integrity_{_name}", lambda spark, sf_dir, t=_template: query(t, raw=_dirty(spark, sf_dir)), f"{_DIRTY_SQL} SELECT * FROM ({_template.format(raw='raw')}) AS answer")
_add("catalog_manifest", catalog.MANIFEST, "walk_i")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded in two parts, the first twice, and read back."""
    root = f"{base.frames_dir(spark)}/store-{uuid4().hex}"
    entries = catalog.manifest(base.frame(spark, sf_dir, "bars", "walk_i")).withColumn("fetched_at", F.lit(1))
    early = F.col("symbol") < "m"
    for part in (entries.filter(early).withColumn("n_bars", F.lit(0).cast("long")), entries.filter(~early), entries.filter(early).withColumn("fetched_at", F.lit(2))):
        catalog.record(part, root)
    return catalog.recorded(spark, root).drop("fetched_at")


_QUERIES["catalog_manifest"] = _manifest
_add("catalog_usable", catalog.usable_sql(1000, ("click",)), "walk_i")
_add("catalog_usable_timeframes", catalog.usable_sql(100, (), ("1h", "4h")), "walk_h")
_own("universe_holdout_anti", lambda spark, sf_dir: spark.sql(catalog.TRAINING), catalog.TRAINING_SQL)
_add("content_hash", catalog.CONTENT_HASH, "walk_h")
_SQL["content_hash"] = f"{base.with_sql('walk_h', ())} SELECT * FROM ({catalog.CONTENT_HASH_SQL.format(bars='walk_h')}) AS answer"

# ---- indicators ----
_add("ind_true_range", indicators.TRUE_RANGE, "walk_d")
_add("ind_log_returns", indicators.LOG_RETURNS, "walk_d")
_add("ind_rolling_min_periods", indicators.ROLLING, "walk_d")
_add("ind_linreg", indicators.LINREG, "walk_h")
_add("ind_squeeze", indicators.SQUEEZE, "walk_h")
_add("ind_atr", indicators.ATR, "walk_d", ("ind",))
_add("ind_rsi", indicators.RSI, "walk_d", ("ind",))
_add("ind_macd", indicators.MACD, "walk_d", ("ind",))

# ---- turning points ----
_POINTS = "source, symbol, timeframe, scale, seq, idx, price, kind, confirmed_idx, is_anchor"
_add("pivots_level0", f"SELECT {_POINTS} FROM {{pivots}} WHERE scale = 0", "walk_i", _P)
_add("pivots_all_levels", f"SELECT {_POINTS} FROM {{pivots}}", "walk_i", _P)
_own("pivots_by_blocks", lambda spark, sf_dir: lattice.build(base.frame(spark, sf_dir, "bars", "walk_i"), 6), _SQL["pivots_all_levels"])
_add("pivots_with_times", lattice.FRAME, "walk_h", ("bars", "pivots"))
_add("lattice_summary", lattice.SUMMARY, "walk_h", _P)
_add("lattice_violations", lattice.VIOLATIONS, "walk_i", _P)
_add("lag_analysis", lattice.LAGS, "walk_i", _P)
_add("lag_by_scale", lattice.LAGS_BY_SCALE, "walk_h", _P)
_add("lag_quotient_range", lattice.LAG_RANGE, "walk_h", _P)

# ---- patterns ----
_add("labelings_by_pattern", labeling.BY_PATTERN, "walk_h", _P)
_add("labelings_substructure", labeling.SUBSTRUCTURE, "walk_h", _P)
_add("labelings_as_of", labeling.as_of_sql(400), "walk_h", _P)
_add("hypotheses_as_of", labeling.hypotheses_sql(400), "walk_h", _P)
_add("hypotheses_alive", labeling.alive_sql(400), "walk_h", ("bars", "pivots"))
_add("wave_ratios", ratios.RATIOS, "walk_h", _P)
_add("fib_hit_rate", ratios.HIT_RATE, "walk_h", _P)
_add("fib_coverage", ratios.coverage_sql(0.1, 3.0), "walk_h", ())
_add("surrogate_series", f"SELECT source, symbol, timeframe, bar_idx, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close FROM ({ratios.surrogate_sql()}) s", "walk_h")


# ---- signals and trades ----
_BP, _BPI = ("bars", "pivots"), ("bars", "pivots", "ind")
_add("as_of_context_pair", signals.pairs_at_sql(400), "walk_h", _P)
_SIGNAL = "source, symbol, timeframe, bar, direction, context_scale, trigger_scale, i0, p0, i1, p1, ti, tp, round(stop, 8) AS stop, round(retrace, 8) AS retrace"
_add("signals_rule", f"SELECT {_SIGNAL} FROM ({signals.signals_sql()}) s", "walk_h", _BP)
_add("signals_trigger", f"SELECT {_SIGNAL} FROM ({signals.signals_sql('trigger', offset=1)}) s", "walk_h", _BP)
_add("signal_guidelines", signals.GUIDELINES, "walk_h", _BPI)
_add("signal_guideline_values", signals.GUIDELINE_VALUES, "walk_h", _BPI)
_add("signal_scores", signals.SCORES, "walk_h", _BPI)
_add("guideline_summary", signals.SUMMARY, "walk_h", _BPI)
_TRADE = "source, symbol, timeframe, bar, context_scale, trigger_scale, direction, entry_bar, exit_bar, entry, round(exit, 8) AS exit, round(stop, 8) AS stop, reason, round(r, 7) AS r"
_add("exit_first_hit", f"SELECT {_TRADE} FROM ({execution.CANDIDATES}) c", "walk_h", _BP)
_add("placebo_market", execution.PLACEBO, "walk_h", _BP)

_TRADES_SQL = execution.greedy_sql(execution.CANDIDATES.format(bars="walk_h", pivots="pivots"))


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {f: base.frame(spark, sf_dir, f, "walk_h") for f in _BP}
    return base.kept(spark, sf_dir, "trades", lambda: execution.backtest(**frames))


def _on_trades(name: str, template: str, check: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {"trades": _trades(spark, sf_dir)}
        if "{bars}" in template:
            used["bars"] = base.frame(spark, sf_dir, "bars", "walk_h")
        return query(template, **used)

    _own(name, run, f"{base.with_sql('walk_h', _P)}, trades AS ({_TRADES_SQL}) SELECT * FROM ({(check or template).format(trades='trades', bars='walk_h')}) AS answer")


_on_trades("backtest_market", f"SELECT {_TRADE} FROM {{trades}}")
_on_trades("backtest_by_reason", execution.BY_REASON)
_on_trades("backtest_percentiles", execution.PERCENTILES)
_on_trades("backtest_by_symbol", execution.BY_SYMBOL)
_on_trades("metrics_portfolio", execution.metrics_sql(tried=6), execution.metrics_check_sql(tried=6))
_on_trades("welch_by_direction", execution.WELCH)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    def made() -> DataFrame:
        scores = query(signals.SCORES, **{f: base.frame(spark, sf_dir, f, "walk_h") for f in _BPI})
        return execution.with_scores(_trades(spark, sf_dir), scores)

    return base.kept(spark, sf_dir, "scored", made)


_SCORED_SQL = f"""{base.with_sql('walk_h', ('pivots', 'ind'))}, trades AS ({_TRADES_SQL}), scores AS ({signals.SCORES.format(bars='walk_h', pivots='pivots', ind='ind')}),
scored AS (SELECT t.*, s.score FROM trades t JOIN scores s ON t.source = s.source AND t.symbol = s.symbol AND t.timeframe = s.timeframe AND t.bar = s.bar AND t.context_scale = s.context_scale)"""
for _name, _template, _check in (
    ("quality_spearman", execution.spearman_sql(), execution.spearman_check_sql()),
    ("quality_by_timeframe", execution.spearman_sql("timeframe"), execution.spearman_check_sql("timeframe")),
    ("quality_by_score", execution.by_score_sql(3), execution.by_score_sql(3)),
):
    _own(_name, lambda spark, sf_dir, t=_template: query(t, scored=_scored(spark, sf_dir)), f"{_SCORED_SQL} SELECT * FROM ({_check.format(scored='scored')}) AS answer")


def _effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = query(signals.GUIDELINES, **{f: base.frame(spark, sf_dir, f, "walk_h") for f in _BPI})
    return query(execution.effects_sql(3), guided=execution.with_guidelines(_trades(spark, sf_dir), met))


_own(
    "guideline_effects",
    _effects,
    f"""{base.with_sql('walk_h', ('pivots', 'ind'))}, trades AS ({_TRADES_SQL}), met AS ({signals.GUIDELINES.format(bars='walk_h', pivots='pivots', ind='ind')}),
guided AS (SELECT t.*, {', '.join(f'm.{n}' for n in signals.NAMES)} FROM trades t JOIN met m ON t.source = m.source AND t.symbol = m.symbol AND t.timeframe = m.timeframe AND t.bar = m.bar AND t.context_scale = m.context_scale)
SELECT * FROM ({execution.effects_sql(3).format(guided='guided')}) AS answer""",
)


# ---- zones and limit orders ----
_ORDER = "source, symbol, timeframe, bar, direction, context_scale, i1, round(limit_price, 7) AS limit_price, round(stop, 7) AS stop, round(target, 7) AS target, extended, expiry_bar, round(rr, 6) AS rr, n_supporting"
_FATE = "source, symbol, timeframe, bar, context_scale, direction, status, entry_bar, exit_bar, round(entry, 7) AS entry, round(exit, 7) AS exit, reason, round(r, 6) AS r"
_add("zone_orders", f"SELECT {_ORDER} FROM ({zones.ORDERS}) o", "walk_h", _BP)
_add("zone_orders_extended_stop", f"SELECT {_ORDER} FROM ({zones.orders_sql('extended')}) o", "walk_h", _BP)
_add("zone_confluence", f"SELECT context_scale, n_supporting, count(*) AS n, round(avg(confluence), 6) AS confluence FROM ({zones.ORDERS}) o GROUP BY context_scale, n_supporting", "walk_h", _BP)
_add("correction_decomposition", zones.DECOMPOSITIONS, "walk_h", _BP)
_add("substructure_orders", f"SELECT {_ORDER} FROM ({zones.SUB_ORDERS}) o", "walk_h", _BP)
_BPS = ("bars", "pivots", "steps")


def _alone(spark: SparkSession, sf_dir: str, which: str, name: str, **options) -> DataFrame:
    """The fates of orders by themselves, kept under a name."""
    frames = {f: base.frame(spark, sf_dir, f, "walk_h") for f in _BPS}
    return base.kept(spark, sf_dir, f"alone {name}", lambda: zones.fates(**frames, which=which, **options))


def _on_alone(name: str, template: str, sql: str, **named) -> None:
    """A query over the fates of orders by themselves. named: {frame: (which orders, options)}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(template, **{k: _alone(spark, sf_dir, which, f"{k} {sorted(o.items())}", **o) for k, (which, o) in named.items()})

    ctes = ", ".join(f"{k} AS ({zones.fates_sql(which, **o).format(bars='walk_h', pivots='pivots')})" for k, (which, o) in named.items())
    _own(name, run, f"{base.with_sql('walk_h', _P)}, {ctes} SELECT * FROM ({(sql or template).format(**{k: k for k in named})}) AS answer")


_on_alone("limit_fills", f"SELECT {_FATE} FROM {{fates}} o", "", fates=(zones.ORDERS, {}))
_on_alone("limit_fills_gap_at_open", f"SELECT {_FATE} FROM {{fates}} o", "", fates=(zones.ORDERS, {"gap_stop_at_open": True}))


def _in_turn(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    name = "fates" if which == zones.ORDERS else "sub fates"
    return base.kept(spark, sf_dir, name, lambda: zones.in_turn(_alone(spark, sf_dir, which, f"{name} []")))


def _on_fates(name: str, template: str, which: str = zones.ORDERS) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(template, fates=_in_turn(spark, sf_dir, which))

    fates = zones.in_turn_sql(zones.fates_sql(which).format(bars="walk_h", pivots="pivots"))
    _own(name, run, f"{base.with_sql('walk_h', _P)}, fates AS ({fates}) SELECT * FROM ({template.format(fates='fates')}) AS answer")


_on_fates("backtest_limit", f"SELECT {_FATE} FROM {{fates}}")
_on_fates("limit_order_fates", zones.FATE_COUNTS)
_on_fates("limit_by_confluence", zones.BY_CONFLUENCE)
_on_fates("limit_by_extension", zones.BY_EXTENSION)
_on_fates("backtest_substructure", f"SELECT {_FATE} FROM {{fates}}", zones.SUB_ORDERS)


_on_alone("placebo_limit", zones.PLACEBO, "", moved=(zones.placebo_sql(), {}))
_on_alone("placebo_control", zones.CONTROL, "", fates=(zones.ORDERS, {}), moved=(zones.placebo_sql(), {}))
_add("chart_points", charts.chart_sql(200), "walk_h", _BP)

# ---- surrogate series and what their turning points give ----
_SURROGATE = f"SELECT source, symbol, timeframe, bar_idx, ts_sec, round(open, 3) AS open, round(high, 3) AS high, round(low, 3) AS low, round(close, 3) AS close, volume FROM ({ratios.surrogates_sql()}) s"


def _lift(template: str) -> tuple:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        def others() -> DataFrame:
            return lattice.build(query(_SURROGATE, bars=base.frame(spark, sf_dir, "bars", "walk_h")))

        return query(template, pivots=base.frame(spark, sf_dir, "pivots", "walk_h"), others=base.kept(spark, sf_dir, "surrogate pivots", others))

    return run, f"{base.with_sql('walk_h', _P)}, moved AS ({_SURROGATE.format(bars='walk_h')}), {duck.pivots('moved', 'others')} SELECT * FROM ({template.format(pivots='pivots', others='others')}) AS answer"


_own("fib_lift", *_lift(ratios.LIFT))
_own("fib_lift_median", *_lift(ratios.LIFT_MEDIAN))

# ---- features, labels, folds ----
_TRENDS = ("ret_5", "ret_20", "ret_60", "ret_120", "atr_rel", "atr_trend", "rsi", "macd_hist_norm", "dist_ma50", "dist_ma200", "vol_rel", "dist_high60", "dist_low60")
_add("features_trend", f"SELECT source, symbol, timeframe, bar_idx, {', '.join(f'round({c}, 6) AS {c}' for c in _TRENDS)}, squeeze_on FROM ({features.TREND}) t", "walk_h", ("ind",))
_NUMBERS = [f"{n}_s{s}" for s in features.SCALES for n in ("retrace", "size_atr", "time")] + ["scale_agree", "length_ratio", "duration_ratio"]
_WHOLE = [f"{n}_s{s}" for s in features.SCALES for n in ("dir", "subwaves")] + ["n_scales_up"]
_add("features_structure", f"SELECT source, symbol, timeframe, bar_idx, {', '.join(f'round({c}, 6) AS {c}' for c in _NUMBERS)}, {', '.join(f'cast({c} as bigint) AS {c}' for c in _WHOLE)} FROM ({features.STRUCTURE}) t", "walk_h", ("pivots", "ind"))
_add("labels_triple_barrier", features.BARRIERS, "walk_h", ("ind",))
_add("labels_forward", features.LABELS, "walk_h", ("ind",))
_add("fold_membership", features.folds_sql(), "walk_h", ("ind",))
_SQL["fold_membership"] = f"{base.with_sql('walk_h', ('ind',))} SELECT * FROM ({features.folds_sql(whole=True).format(ind='ind')}) AS answer"


def _dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.kept(spark, sf_dir, "dataset", lambda: features.dataset(base.frame(spark, sf_dir, "ind", "walk_h"), base.frame(spark, sf_dir, "pivots", "walk_h")))


def _predicted(spark: SparkSession, sf_dir: str, structure: bool = True) -> DataFrame:
    """Predictions of the walk-forward with all features, or with those of trend alone; folds may be as small as fold_membership's."""
    return base.kept(spark, sf_dir, f"predicted {structure}", lambda: features.walk_forward(_dataset(spark, sf_dir), structure=structure, least_train=100, least_test=20))


#: The symbols that count as a class of their own; all others are the other class.
_CLASS = ("click", "view")
_own("gbt_walk_forward", lambda spark, sf_dir: query(features.REPORT, predicted=_predicted(spark, sf_dir)))
_own("gbt_holdout", lambda spark, sf_dir: query(features.REPORT, predicted=features.holdout(_dataset(spark, sf_dir), ("click",))))
_own("gbt_importances", lambda spark, sf_dir: features.importances(_dataset(spark, sf_dir)))
_own("gbt_feature_sets", lambda spark, sf_dir: query(features.FEATURE_SETS, trend=_predicted(spark, sf_dir, False), both=_predicted(spark, sf_dir)))
_own("gbt_controls", lambda spark, sf_dir: query(features.controls_sql(_CLASS, 10), predicted=_predicted(spark, sf_dir, False)))

# ---- risk ----
_add("correlation_pairs", risk.CORRELATIONS, "walk_d")
_add("correlation_pairs_by_time", risk.correlations_sql("ts"), "walk_d")
_QUERIES["correlation_pairs"] = lambda spark, sf_dir: risk.correlations(base.frame(spark, sf_dir, "bars", "walk_d"))
_QUERIES["correlation_pairs_by_time"] = lambda spark, sf_dir: risk.correlations(base.frame(spark, sf_dir, "bars", "walk_d"), "ts")
#: The series here are nearly independent, so a threshold that parts them is low.
_APART = 0.03
_own(
    "correlation_clusters",
    lambda spark, sf_dir: risk.clusters(risk.correlations(base.frame(spark, sf_dir, "bars", "walk_d")), _APART),
    f"{base.with_sql('walk_d', ())} {risk.clusters_check_sql(risk.CORRELATIONS.format(bars='walk_d'), _APART)}",
)
_add("challenge_no_edge", risk.NO_EDGE, "walk_h", ())
_STATES = "(SELECT * FROM (VALUES (0, 0e0, 0e0, 0, 0e0), (0, 0e0, 0e0, 3, 0.8e0), (6, 0e0, 0e0, 0, 0e0), (2, 0.035e0, 0e0, 0, 0e0), (2, 0.01e0, 0.015e0, 1, 0.2e0), (1, 0.05e0, 0e0, 0, 1e0)) AS v(n_open, heat, cluster_heat, losses, drawdown_used))"
_add("risk_allowance", risk.allowance_sql(_STATES), "walk_h", ())
_on_trades("required_r", risk.REQUIRED)


def _challenge(spark: SparkSession, sf_dir: str, rules: risk.Rules | tuple[risk.Rules, ...] = risk.Rules()) -> DataFrame:
    """All finished limit orders, drawn as often a day as they came."""
    found = risk.results(_in_turn(spark, sf_dir, zones.ORDERS).filter("reason is not null")).toPandas()
    seconds = base.frame(spark, sf_dir, "bars", "walk_h").agg(F.max("ts_sec") - F.min("ts_sec")).first()[0] or 0
    n = int(found.n.sum())
    if n < 20:  # too few on the smallest tables
        return spark.createDataFrame([], "risk double, p_pass double, p_fail double, p_daily double, p_open double, median_days double")
    a_day = n / max(seconds / 31_557_600, 1e-9) / 252
    return risk.challenge(spark, found.r.tolist(), rules, list(risk.RISKS), max(a_day, 0.05), counts=found.n.tolist())


_own("challenge_mc", _challenge)
_own("challenge_two_phases", lambda spark, sf_dir: _challenge(spark, sf_dir, risk.two_phases()))
_own("challenge_best_risk", lambda spark, sf_dir: risk.best_risk(_challenge(spark, sf_dir)))


# ---- streams: tables replayed in batches, the state kept between them ----
_STREAMED = ("mean_50", "max_60", "min_60", "volume_20", "linreg_20", "squeeze_on", "squeeze_off", "momentum", "ret_5", "ret_20", "ret_60", "ret_120")
_PLACES = {"mean_50": 6, "volume_20": 6, "linreg_20": 4, "momentum": 4, "ret_5": 9, "ret_20": 9, "ret_60": 9, "ret_120": 9, "mean_200": 6}
_rounded = lambda c: f"round({c}, {_PLACES[c]}) AS {c}" if c in _PLACES else c


def _stream_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = base.frame(spark, sf_dir, "bars", "walk_h")
    found = replay.replayed(bars, sliding.sliding, "bar_idx", replay.even_cuts(bars, "bar_idx", 3))
    return found.selectExpr("source", "symbol", "timeframe", "bar_idx", "round(mean_200, 6) AS mean_200", *map(_rounded, _STREAMED))


_WINDOWS = " JOIN ".join(
    f"({t.format(bars='walk_h')}) {a}" + (f" ON {plain_on('r', a)} AND r.bar_idx = {a}.bar_idx" if a != "r" else "")
    for a, t in (("r", indicators.ROLLING), ("l", indicators.LINREG), ("q", indicators.SQUEEZE), ("g", indicators.LOG_RETURNS), ("m", f"SELECT source, symbol, timeframe, bar_idx, {indicators.rolling('avg(close)', 200)} AS mean_200 FROM {{bars}}"))
)
_own("stream_indicators", _stream_indicators, f"{base.with_sql('walk_h', ())} SELECT r.source, r.symbol, r.timeframe, r.bar_idx, {', '.join(map(_rounded, ('mean_200', *_STREAMED)))} FROM {_WINDOWS}")


def _waits(spark: SparkSession, sf_dir: str, placed: DataFrame, parts: int = 3) -> DataFrame:
    """What becomes of what is placed, the bars cut at even times; the clock then passes all deadlines."""
    bars = base.frame(spark, sf_dir, "bars", "walk_h")
    first, last = bars.agg(F.min("ts_sec"), F.max("ts_sec")).first()
    if first is None:
        first = last = 0
    after = last + 2 * zones.DEADLINE
    events = waiting.events_of(bars, placed, clock=(after, after + 1))
    cuts = [first + (last + 1 - first) * k // parts for k in range(1, parts)] + [last + 1, after + 1]
    return replay.replayed(events, waiting.ends, "ts_sec", cuts)


def _stream_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {f: base.frame(spark, sf_dir, f, "walk_h") for f in _BP}
    placed = base.kept(spark, sf_dir, "placed orders", lambda: query(zones.PLACED, **frames))
    ended = _waits(spark, sf_dir, placed)
    return query("SELECT p.source, p.symbol, p.timeframe, p.bar, p.context_scale, p.direction, e.what AS status, CASE WHEN e.what = 'filled' THEN e.bar_idx END AS entry_bar FROM {placed} p LEFT JOIN {ended} e ON e.id = p.id", placed=placed, ended=ended)


_own("stream_orders", _stream_orders, f"{base.with_sql('walk_h', _P)} SELECT source, symbol, timeframe, bar, context_scale, direction, status, entry_bar FROM ({zones.fates_sql(zones.ORDERS).format(bars='walk_h', pivots='pivots')}) f")


def _stream_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = {f: base.frame(spark, sf_dir, f, "walk_h") for f in _BP}
    placed = base.kept(spark, sf_dir, "placed hypotheses", lambda: query(labeling.PLACED, **frames))
    ended = _waits(spark, sf_dir, placed)
    return query("SELECT p.source, p.symbol, p.timeframe, p.scale, p.next_wave, p.direction, e.bar_idx AS invalid_bar FROM {placed} p LEFT JOIN {ended} e ON e.id = p.id", placed=placed, ended=ended)


_own("stream_hypotheses", _stream_hypotheses, f"{base.with_sql('walk_h', _P)} SELECT * FROM ({labeling.INVALID.format(bars='walk_h', pivots='pivots')}) f")

_BOOKED = """
SELECT t.source AS portfolio, t.symbol, concat(t.symbol, '/', cast(t.context_scale as varchar(9))) AS cluster, e.ts_sec AS entry_sec, x.ts_sec AS exit_sec, t.r, 0.1e0 AS max_drawdown
FROM {trades} t JOIN {bars} e ON e.source = t.source AND e.symbol = t.symbol AND e.timeframe = t.timeframe AND e.bar_idx = t.entry_bar
JOIN {bars} x ON x.source = t.source AND x.symbol = t.symbol AND x.timeframe = t.timeframe AND x.bar_idx = t.exit_bar"""


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unselected signals, so that positions overlap."""
    frames = {f: base.frame(spark, sf_dir, f, "walk_h") for f in _BP}
    trades = base.kept(spark, sf_dir, "candidates", lambda: query(execution.CANDIDATES, **frames))
    rows = base.kept(spark, sf_dir, "booked", lambda: query(_BOOKED, trades=trades, bars=frames["bars"]))
    middle = rows.approxQuantile("entry_sec", [0.3, 0.7], 0.05)
    played = replay.replayed(rows, waiting.book, "entry_sec", [int(x) for x in middle])
    return played.selectExpr("portfolio", "symbol", "cluster", "entry_sec", "exit_sec", "round(r, 7) AS r", "round(allowed, 9) AS allowed")


_own("book_allowed", _book, f"{base.with_sql('walk_h', _P)}, candidates AS ({execution.CANDIDATES.format(bars='walk_h', pivots='pivots')}), booked AS ({_BOOKED.format(trades='candidates', bars='walk_h')}) {risk.book_check_sql('SELECT * FROM booked')}")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.replayed(base.frame(spark, sf_dir, "bars", "walk_h"))


_add("stream_pivots", "SELECT source, symbol, timeframe, scale, idx, price, kind, confirmed_idx, is_anchor FROM {pivots}", "walk_h", _P)
_QUERIES["stream_pivots"] = _stream


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    """Ranges of bars are joined by range alone here, without the blocks by which Spark cuts them."""
    return {name: plain(sql) for name, sql in _SQL.items()}


