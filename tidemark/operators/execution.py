"""What becomes of signals: barrier exits bar by bar, one position at a time, and the figures of trades.

Within a bar the stop counts before the target; entry is at the next bar's open; both sides cost.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.student import p_value
from tidemark.operators.signals import NAMES, signals_sql
from tidemark.operators.turns import with_turns
from tidemark.plans.frames import KEY, in_block, on, query, scattered, spread


@dataclass(frozen=True)
class Policy:
    """Target and break-even in multiples of the risk, the time stop, the stop's buffer, costs a side."""

    target: float = 3.0
    breakeven: float = 1.0
    max_bars: int = 200
    buffer: float = 0.0
    per_side: float = 0.001


def candidates_sql(signals: str, p: Policy = Policy()) -> str:
    """Every signal as if it were the only one: entry, exit, reason and r. signals: KEY, bar, direction, stop and more."""
    sid = "source, symbol, timeframe, bar, context_scale"
    touched = "(s.direction > 0 AND b.low <= {0} OR s.direction < 0 AND b.high >= {0})"
    reached = "(s.direction > 0 AND b.high >= s.target OR s.direction < 0 AND b.low <= s.target)"
    gained = f"(CASE WHEN s.direction > 0 THEN b.high - s.entry ELSE s.entry - b.low END >= {p.breakeven} * s.risk)"
    far = 2147483647
    window = "AND b.bar_idx >= s.entry_bar AND b.bar_idx <= s.last_bar"
    cols = "s.source, s.symbol, s.timeframe, s.bar, s.context_scale, s.direction, s.trigger_scale, s.entry_bar, s.entry, s.stop, s.risk, s.target, s.last_bar"
    return f"""
WITH placed AS (
  SELECT *, abs(entry - stop) AS risk, entry + direction * {p.target} * abs(entry - stop) AS target FROM (
    SELECT g.source, g.symbol, g.timeframe, g.bar, g.context_scale, g.direction, g.trigger_scale, b.bar_idx AS entry_bar, b.open AS entry, g.stop - g.direction * {p.buffer} * abs(b.open - g.stop) AS stop, least(n.n_bars - 1, g.bar + 1 + {p.max_bars}) AS last_bar
    FROM ({signals}) g JOIN {{bars}} b ON {on("b", "g")} AND b.bar_idx = g.bar + 1 JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{bars}} GROUP BY {KEY}) n ON {on("n", "g")}) e
  WHERE direction * (entry - stop) > 0),
first_hits AS (
  SELECT {cols}, coalesce(min(CASE WHEN {touched.format("s.stop")} THEN b.bar_idx END), {far}) AS t_stop, coalesce(min(CASE WHEN {reached} THEN b.bar_idx END), {far}) AS t_target, coalesce(min(CASE WHEN {gained} THEN b.bar_idx END), {far}) AS t_even
  FROM {spread("placed", "entry_bar", "last_bar")} s JOIN {{bars}} b ON {on("b", "s")} {in_block("b", "s")} {window} GROUP BY {cols}),
after_even AS (
  SELECT {", ".join(f"s.{c}" for c in sid.split(", "))}, min(b.bar_idx) AS t_back FROM {spread("first_hits", "entry_bar", "last_bar")} s JOIN {{bars}} b ON {on("b", "s")} {in_block("b", "s")} {window} AND b.bar_idx > s.t_even AND {touched.format("s.entry")}
  WHERE s.t_even < least(s.t_stop, s.t_target) GROUP BY {", ".join(f"s.{c}" for c in sid.split(", "))}),
ended AS (
  SELECT f.*, CASE WHEN f.t_even < least(f.t_stop, f.t_target) THEN CASE WHEN coalesce(a.t_back, {far}) <= f.t_target AND a.t_back IS NOT NULL THEN 'breakeven' WHEN f.t_target < {far} THEN 'target' ELSE 'time_stop' END
         WHEN f.t_stop <= f.t_target AND f.t_stop < {far} THEN 'stop' WHEN f.t_target < {far} THEN 'target' ELSE 'time_stop' END AS reason, a.t_back
  FROM first_hits f LEFT JOIN after_even a ON {on("a", "f")} AND a.bar = f.bar AND a.context_scale = f.context_scale)
SELECT {KEY}, bar, context_scale, trigger_scale, direction, entry_bar, exit_bar, entry, exit, stop, reason, ((exit - entry) * direction - (entry + exit) * {p.per_side}) / risk AS r FROM (
  SELECT e.source, e.symbol, e.timeframe, e.bar, e.context_scale, e.trigger_scale, e.direction, e.entry_bar, e.entry, e.stop, e.risk, e.reason, x.bar_idx AS exit_bar,
         CASE e.reason WHEN 'stop' THEN e.stop WHEN 'target' THEN e.target WHEN 'breakeven' THEN e.entry ELSE x.close END AS exit
  FROM ended e JOIN {{bars}} x ON {on("x", "e")} AND x.bar_idx = CASE e.reason WHEN 'stop' THEN e.t_stop WHEN 'target' THEN e.t_target WHEN 'breakeven' THEN e.t_back ELSE e.last_bar END) o"""


_TRADES = f"{KEY}, bar, context_scale, trigger_scale, direction, entry_bar, exit_bar, entry, exit, stop, reason, r"


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """The trades that a single position a series allows, in order of the bar, then of the scale."""
    return with_turns(trades, "entry_bar", "exit_bar").filter("taken").select(*trades.columns)


def greedy_sql(trades: str, first: str = "entry_bar") -> str:
    """The same as a fold over lists, for DuckDB."""
    return f"""
SELECT t.* EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY bar, context_scale) AS k FROM ({trades}) c) t
JOIN (SELECT {KEY}, unnest(list_reduce(list({{'k': k, 'first': {first}, 'last': exit_bar}} ORDER BY k), lambda acc, x: CASE WHEN x.first > acc.busy THEN {{'busy': x.last, 'kept': list_append(acc.kept, x.k)}} ELSE acc END, {{'busy': -1, 'kept': []::BIGINT[]}}).kept) AS k
      FROM (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY bar, context_scale) AS k, {first}, exit_bar FROM ({trades}) c) l GROUP BY {KEY}) g
ON t.source = g.source AND t.symbol = g.symbol AND t.timeframe = g.timeframe AND t.k = g.k"""


CANDIDATES = candidates_sql(signals_sql())


def backtest(bars: DataFrame, pivots: DataFrame, stop: str = "rule", policy: Policy = Policy()) -> DataFrame:
    """Trades of the confirmation signals, one at a time in each series."""
    return one_at_a_time(query(candidates_sql(signals_sql(stop), policy), bars=bars, pivots=pivots))


# ---- figures of {trades}: KEY, bar, context_scale, entry_bar, exit_bar, direction, reason, r, ... ----

BY_REASON = "SELECT reason, count(*) AS n, round(count(*) / cast(sum(count(*)) OVER () as double), 8) AS share, round(avg(r), 6) AS mean_r FROM {trades} GROUP BY reason"
PERCENTILES = "SELECT " + ", ".join(f"round(percentile_cont({q / 100}) WITHIN GROUP (ORDER BY r), 6) AS p{q:02d}" for q in (5, 25, 50, 75, 95)) + ", count(*) AS n FROM {trades}"
BY_SYMBOL = f"SELECT {KEY}, count(*) AS n, round(avg(r), 6) AS mean_r, round(sum(r), 6) AS total_r, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM {{trades}} GROUP BY {KEY}"


def expected_max(n: int) -> float:
    """How high the best of n Sharpe ratios without any edge is expected, in its own deviations."""
    if n <= 1:
        return 0.0
    z, gamma = NormalDist().inv_cdf, 0.5772156649
    return (1 - gamma) * z(1 - 1 / n) + gamma * z(1 - 1 / (n * 2.718281828459045))


def metrics_sql(risk: float = 0.01, tried: int = 1) -> str:
    """The figures of all trades together in order of exit; {trades} joined with {bars} for its times.

    max_dd_pct is the largest drop over the highest point of all; max_dd_rel is the
    largest drop from the highest point before it. Running figures are taken over days first and then within each day,
    so the only window without a key has a row for each day.
    """
    within = "PARTITION BY day ORDER BY exit_sec, symbol, entry_bar, context_scale, source, timeframe ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
WITH timed AS (
  SELECT t.*, e.ts_sec AS entry_sec, x.ts_sec AS exit_sec, floor(x.ts_sec / 86400) AS day, ln(greatest(1 + t.r * {risk}, 1e-12)) AS growth
  FROM {{trades}} t JOIN {{bars}} e ON {on("e", "t")} AND e.bar_idx = t.entry_bar JOIN {{bars}} x ON {on("x", "t")} AND x.bar_idx = t.exit_bar),
days AS (SELECT day, coalesce(sum(r) OVER ({before}), 0e0) AS r_before, coalesce(sum(growth) OVER ({before}), 0e0) AS growth_before FROM (SELECT day, sum(r) AS r, sum(growth) AS growth FROM timed GROUP BY day) d),
running AS (
  SELECT t.*, d.r_before + sum(r) OVER ({within}) AS cum_r, exp(d.growth_before + sum(growth) OVER ({within})) AS curve
  FROM (SELECT * FROM timed) t JOIN days d USING (day)),
tops AS (SELECT day, max(cum_r) OVER ({before}) AS top_r, max(curve) OVER ({before}) AS top FROM (SELECT day, max(cum_r) AS cum_r, max(curve) AS curve FROM running GROUP BY day) d),
curves AS (
  SELECT w.*, greatest(coalesce(top, curve), max(curve) OVER ({within})) AS peak, greatest(coalesce(top_r, cum_r), max(cum_r) OVER ({within})) AS peak_r
  FROM running w JOIN tops USING (day))
SELECT n, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(total_r, 5) AS total_r, round(max_dd_r, 5) AS max_dd_r,
       round(max_dd_pct, 6) AS max_dd_pct, round(max_dd_rel, 6) AS max_dd_rel, round(years, 6) AS years, round(exp(ln(curve_end) / nullif(years, 0)) - 1, 6) AS cagr, round(expectancy / nullif(sd, 0) * sqrt(n / nullif(years, 0)), 5) AS sharpe,
       round((exp(ln(curve_end) / nullif(years, 0)) - 1) / nullif(max_dd_pct, 0), 5) AS mar, CASE WHEN n >= 10 THEN round((expectancy / nullif(sd, 0) - {expected_max(tried)!r} / sqrt(cast(n as double))) * sqrt(n / nullif(years, 0)), 5) END AS deflated_sharpe
FROM (
  SELECT count(*) AS n, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(r) AS expectancy, coalesce(avg(CASE WHEN r > 0 THEN r END), 0e0) AS avg_win, coalesce(avg(CASE WHEN r <= 0 THEN r END), 0e0) AS avg_loss, sum(r) AS total_r, stddev_samp(r) AS sd,
         max(greatest(peak_r, 0e0) - cum_r) AS max_dd_r, max(peak - curve) / max(peak) AS max_dd_pct, max((peak - curve) / peak) AS max_dd_rel, exp(sum(growth)) AS curve_end, (greatest(max(exit_sec), max(entry_sec)) - least(min(exit_sec), min(entry_sec))) / 31557600e0 AS years
  FROM curves) m"""


def metrics_check_sql(risk: float = 0.01, tried: int = 1) -> str:
    """metrics_sql by running sums over all trades at once, for checking."""
    order = "ORDER BY exit_sec, symbol, entry_bar, context_scale"
    upto = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
SELECT n, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(avg_win, 6) AS avg_win, round(avg_loss, 6) AS avg_loss, round(total_r, 5) AS total_r, round(max_dd_r, 5) AS max_dd_r,
       round(max_dd_pct, 6) AS max_dd_pct, round(max_dd_rel, 6) AS max_dd_rel, round(years, 6) AS years, round(exp(ln(curve_end) / nullif(years, 0)) - 1, 6) AS cagr, round(expectancy / nullif(sd, 0) * sqrt(n / nullif(years, 0)), 5) AS sharpe,
       round((exp(ln(curve_end) / nullif(years, 0)) - 1) / nullif(max_dd_pct, 0), 5) AS mar, CASE WHEN n >= 10 THEN round((expectancy / nullif(sd, 0) - {expected_max(tried)!r} / sqrt(cast(n as double))) * sqrt(n / nullif(years, 0)), 5) END AS deflated_sharpe
FROM (
  SELECT count(*) AS n, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, avg(r) AS expectancy, coalesce(avg(CASE WHEN r > 0 THEN r END), 0e0) AS avg_win, coalesce(avg(CASE WHEN r <= 0 THEN r END), 0e0) AS avg_loss, sum(r) AS total_r, stddev_samp(r) AS sd,
         max(greatest(peak_r, 0e0) - cum_r) AS max_dd_r, max(peak - curve) / max(peak) AS max_dd_pct, max((peak - curve) / peak) AS max_dd_rel, max_by(curve, k) AS curve_end, (greatest(max(exit_sec), max(entry_sec)) - least(min(exit_sec), min(entry_sec))) / 31557600e0 AS years
  FROM (SELECT *, max(curve) OVER {upto} AS peak, max(cum_r) OVER {upto} AS peak_r, row_number() OVER ({order}) AS k FROM (
    SELECT t.*, e.ts_sec AS entry_sec, x.ts_sec AS exit_sec, sum(t.r) OVER (ORDER BY x.ts_sec, t.symbol, t.entry_bar, t.context_scale ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_r,
           exp(sum(ln(greatest(1 + t.r * {risk}, 1e-12))) OVER (ORDER BY x.ts_sec, t.symbol, t.entry_bar, t.context_scale ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS curve
    FROM {{trades}} t JOIN {{bars}} e ON {on("e", "t")} AND e.bar_idx = t.entry_bar JOIN {{bars}} x ON {on("x", "t")} AND x.bar_idx = t.exit_bar) c) d) m"""


def _welch(one: str, other: str) -> tuple[str, str]:
    """Welch's t and its degrees of freedom, from columns n_, mean_ and var_ of two groups."""
    se = f"(var_{one} / n_{one} + var_{other} / n_{other})"
    parts = " + ".join(f"power(var_{g} / n_{g}, 2) / nullif(n_{g} - 1, 0)" for g in (one, other))
    return f"(mean_{one} - mean_{other}) / nullif(sqrt({se}), 0)", f"power({se}, 2) / nullif({parts}, 0)"


_T, _NU = _welch("long", "short")
WELCH = f"""
SELECT n_long, n_short, round(mean_long, 6) AS mean_long, round(mean_short, 6) AS mean_short, round(t, 5) AS t, round(nu, 5) AS nu, round({p_value("t", "nu")}, 8) AS p FROM (
  SELECT *, cast({_T} as double) AS t, cast({_NU} as double) AS nu FROM (
    SELECT sum(CASE WHEN direction > 0 THEN 1 ELSE 0 END) AS n_long, sum(CASE WHEN direction < 0 THEN 1 ELSE 0 END) AS n_short, avg(CASE WHEN direction > 0 THEN r END) AS mean_long, avg(CASE WHEN direction < 0 THEN r END) AS mean_short,
           var_samp(CASE WHEN direction > 0 THEN r END) AS var_long, var_samp(CASE WHEN direction < 0 THEN r END) AS var_short FROM {{trades}}) w) v"""


def _ranks(table: str, value: str) -> str:
    """Mean ranks of a column's values per timeframe group, from counts: no window holds all rows, only all thousandths."""
    return f"""
SELECT part, {value}, before + coalesce(sum(n) OVER (PARTITION BY part, bucket ORDER BY {value} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2e0 AS rank_of
FROM (SELECT v.part, v.bucket, v.{value}, v.n, b.before
      FROM (SELECT part, floor({value} * 1000) AS bucket, {value}, count(*) AS n FROM {table} GROUP BY part, floor({value} * 1000), {value}) v
      JOIN (SELECT part, bucket, coalesce(sum(n) OVER (PARTITION BY part ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM (SELECT part, floor({value} * 1000) AS bucket, count(*) AS n FROM {table} GROUP BY part, floor({value} * 1000)) c) b
      ON b.part = v.part AND b.bucket = v.bucket) p"""


def spearman_sql(part: str = "'all'") -> str:
    """Spearman's rank correlation of score and r in each part, ties at their mean rank, its t (n - 2 degrees of freedom) and p.

    {scored}: trades with score.
    """
    return f"""
WITH rows AS (SELECT {part} AS part, cast(score as double) AS score, r FROM {{scored}}),
by_score AS ({_ranks("rows", "score")}), by_r AS ({_ranks("rows", "r")})
SELECT part, n, mean_r, rho, round(t, 4) AS t, round({p_value("t", "nu")}, 8) AS p FROM (
  SELECT *, cast(raw * sqrt((n - 2) / nullif(1 - raw * raw, 0)) as double) AS t, cast(n - 2 as double) AS nu FROM (
    SELECT part, count(*) AS n, round(avg(w.r), 6) AS mean_r, round(corr(s.rank_of, q.rank_of), 6) AS rho, corr(s.rank_of, q.rank_of) AS raw
    FROM rows w JOIN by_score s USING (part, score) JOIN by_r q USING (part, r) GROUP BY part) c) v"""


def spearman_check_sql(part: str = "'all'") -> str:
    """The same by ranking all rows at once, for checking."""
    return f"""
SELECT part, n, mean_r, rho, round(t, 4) AS t, round({p_value("t", "nu")}, 8) AS p FROM (SELECT *, cast(raw * sqrt((n - 2) / nullif(1 - raw * raw, 0)) as double) AS t, cast(n - 2 as double) AS nu FROM (
SELECT part, count(*) AS n, round(avg(r), 6) AS mean_r, round(corr(rank_s, rank_r), 6) AS rho, corr(rank_s, rank_r) AS raw
FROM (SELECT part, r, rank() OVER (PARTITION BY part ORDER BY score) + (count(*) OVER (PARTITION BY part, score) - 1) / 2e0 AS rank_s,
             rank() OVER (PARTITION BY part ORDER BY r) + (count(*) OVER (PARTITION BY part, r) - 1) / 2e0 AS rank_r
      FROM (SELECT {part} AS part, score, r FROM {{scored}}) w) k GROUP BY part) c) v"""


def by_score_sql(least: int = 10) -> str:
    """Only scores with so many trades and more tell anything."""
    return f"""
SELECT score, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate,
       round(avg(CASE WHEN r > 0 THEN r END), 6) AS avg_win, round(avg(CASE WHEN r <= 0 THEN r END), 6) AS avg_loss, round(sum(r), 5) AS total_r
FROM {{scored}} GROUP BY score HAVING count(*) >= {least}"""


BY_SCORE = by_score_sql()


def effects_sql(least: int = 20) -> str:
    """What each guideline adds: trades that meet it against those that don't, Welch's t, and the |t| that as many tests ask for.

    {guided}: trades with the nine guidelines. Guidelines with fewer than least trades on either side are left out.
    """
    cases = " ".join(f"WHEN '{n}' THEN {n}" for n in NAMES)
    needed = " ".join(f"WHEN {k} THEN {NormalDist().inv_cdf(1 - 0.025 / k)!r}e0" for k in range(1, len(NAMES) + 1))
    return f"""
SELECT guideline, n_yes, n_no, round(n_yes / cast(n_yes + n_no as double), 6) AS share, round(mean_yes, 6) AS mean_yes, round(mean_no, 6) AS mean_no, round(mean_yes - mean_no, 6) AS difference, round(t, 5) AS t, round({p_value("t", "nu")}, 8) AS p,
       row_number() OVER (ORDER BY abs(round(t, 5)) DESC, guideline) AS place, round(CASE count(*) OVER () {needed} END, 6) AS t_needed
FROM (
  SELECT *, cast({_welch("yes", "no")[0]} as double) AS t, cast({_welch("yes", "no")[1]} as double) AS nu FROM (
    SELECT guideline, sum(CASE WHEN met THEN 1 ELSE 0 END) AS n_yes, sum(CASE WHEN met THEN 0 ELSE 1 END) AS n_no, avg(CASE WHEN met THEN r END) AS mean_yes, avg(CASE WHEN NOT met THEN r END) AS mean_no,
           var_samp(CASE WHEN met THEN r END) AS var_yes, var_samp(CASE WHEN NOT met THEN r END) AS var_no
    FROM (SELECT guideline, r, CASE guideline {cases} END AS met FROM {{guided}} CROSS JOIN (VALUES {", ".join(f"('{n}')" for n in NAMES)}) AS g(guideline)) m
    GROUP BY guideline) w WHERE n_yes >= {least} AND n_no >= {least}) e"""



def metrics(trades: DataFrame, bars: DataFrame, risk: float = 0.01, tried: int = 1) -> DataFrame:
    return query(metrics_sql(risk, tried), trades=trades, bars=bars)


# ---- placebo: the same trades at other times ----


def placebo_sql(draws: int = 20, seed: int = 7) -> str:
    """Signals moved to scattered bars, each draw by itself, with their stop at the same distance in proportion."""
    place = scattered(f"cast(s.bar as bigint) * 7919 + s.context_scale * 104729 + d.draw * 15485863 + {seed * 32452843}")
    draw = f"({place} % greatest(n.n_bars - 22, 1) + 20)"
    numbers = ", ".join(f"({i})" for i in range(draws))
    return f"""
SELECT p.source, p.symbol, p.timeframe, cast(p.new_bar as int) AS bar, p.direction, cast(p.draw * 100 + p.context_scale as bigint) * 4294967296 + p.bar AS context_scale, p.trigger_scale, e.open - p.direction * p.distance * e.open AS stop
FROM (SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale, s.trigger_scale, d.draw, s.direction, abs(b.open - s.stop) / b.open AS distance, {draw} AS new_bar
      FROM ({signals_sql()}) s CROSS JOIN (VALUES {numbers}) AS d(draw) JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{bars}} GROUP BY {KEY}) n ON {on("n", "s")}
      JOIN {{bars}} b ON {on("b", "s")} AND b.bar_idx = s.bar + 1) p
JOIN {{bars}} e ON {on("e", "p")} AND e.bar_idx = p.new_bar + 1"""


PLACEBO = f"SELECT direction, count(*) AS n, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS sd_r FROM ({candidates_sql(placebo_sql())}) c GROUP BY direction"


def with_scores(trades: DataFrame, scores: DataFrame) -> DataFrame:
    return trades.join(scores.select(*KEY.split(", "), "bar", "context_scale", "score"), [*KEY.split(", "), "bar", "context_scale"]).select(*[F.col(c) for c in trades.columns], "score")


def with_guidelines(trades: DataFrame, guidelines: DataFrame) -> DataFrame:
    keys = [*KEY.split(", "), "bar", "context_scale"]
    return trades.join(guidelines.select(*keys, *NAMES), keys).select(*[F.col(c) for c in trades.columns], *NAMES)
