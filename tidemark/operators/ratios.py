"""Ratios of waves, how often they lie near Fibonacci levels, and surrogate series to compare with."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators.labeling import LABELINGS
from tidemark.plans.frames import KEY, on, query, scattered

#: The levels that ratios are said to prefer.
LEVELS = (0.236, 0.382, 0.5, 0.618, 0.786, 1.0, 1.272, 1.618, 2.0, 2.618)
TOLERANCE = 0.05


def _w(i: int) -> str:
    return f"abs(ln(p{i + 1}) - ln(p{i}))"


def _t(i: int) -> str:
    return f"cast(i{i + 1} - i{i} as double)"


def _ratio(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0))"


_FIVE = {
    "w2_retrace_w1": _ratio(_w(1), _w(0)), "w4_retrace_w3": _ratio(_w(3), _w(2)), "w3_ext_w1": _ratio(_w(2), _w(0)), "w5_ext_w1": _ratio(_w(4), _w(0)), "w5_ext_w3": _ratio(_w(4), _w(2)),
    "t2_t1": _ratio(_t(1), _t(0)), "t4_t3": _ratio(_t(3), _t(2)), "t3_t1": _ratio(_t(2), _t(0)),
    "alternation": f"CASE WHEN {_w(0)} > 0 AND {_w(2)} > 0 THEN greatest({_ratio(_w(1), _w(0))}, {_ratio(_w(3), _w(2))}) / nullif(least({_ratio(_w(1), _w(0))}, {_ratio(_w(3), _w(2))}), 0) END",
}
_THREE = {"b_retrace_a": _ratio(_w(1), _w(0)), "c_ext_a": _ratio(_w(2), _w(0)), "tb_ta": _ratio(_t(1), _t(0)), "tc_ta": _ratio(_t(2), _t(0))}


_NAMES = [(n, "five") for n in _FIVE] + [(n, "three") for n in _THREE]
_VALUES = ", ".join(f"('{n}', '{kind}')" for n, kind in _NAMES)
_KIND = "CASE WHEN pattern IN ('impulse', 'leading_diagonal', 'ending_diagonal') THEN 'five' WHEN pattern IN ('zigzag', 'flat') THEN 'three' END"
_VALUE = "CASE ratio " + " ".join(f"WHEN '{n}' THEN {expr}" for n, expr in {**_FIVE, **_THREE}.items()) + " END"

#: One row for each labeling and ratio; a wave of no length gives null. Patterns of other kinds have no ratios.
RATIOS = f"""
SELECT {KEY}, scale, seq, pattern, ratio, round({_VALUE}, 8) AS value
FROM (SELECT *, {_KIND} AS kind_of FROM ({LABELINGS}) l) k JOIN (VALUES {_VALUES}) AS r(ratio, kind) ON r.kind = k.kind_of"""

_NEAR = " OR ".join(f"abs(value - {x}) <= {TOLERANCE * x}" for x in LEVELS)
HIT_RATE = f"SELECT ratio, count(*) AS n, round(avg(CASE WHEN {_NEAR} THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM ({RATIOS}) v WHERE value IS NOT NULL GROUP BY ratio"


def coverage_sql(low: float, high: float) -> str:
    """The part of [low, high] that lies near a level: the union of the bands around them over the range's length."""
    bands = ", ".join(f"({x * (1 - TOLERANCE)}, {x * (1 + TOLERANCE)})" for x in LEVELS)
    return f"""
SELECT round(coalesce(sum(hi - lo), 0) / ({high} - {low}), 9) AS coverage, count(*) AS n_intervals FROM (
  SELECT min(lo) AS lo, max(hi) AS hi FROM (
    SELECT lo, hi, sum(CASE WHEN lo > before THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi) AS island FROM (
      SELECT lo, hi, coalesce(max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo - 1) AS before FROM (
        SELECT greatest(cast(lo as double), {low}) AS lo, least(cast(hi as double), {high}) AS hi FROM (VALUES {bands}) AS b(lo, hi)) c WHERE hi > lo) d) e GROUP BY island) f"""


#: Two proportions: ratios between the first and last percentile of both, observed against surrogate.
LIFT = """
SELECT ratio, n_observed, n_surrogate, round(p_o, 6) AS observed, round(p_s, 6) AS surrogate, round(p_o / nullif(p_s, 0), 6) AS lift,
       round((p_o - p_s) / nullif(sqrt((hits_o + hits_s) / cast(n_observed + n_surrogate as double) * (1 - (hits_o + hits_s) / cast(n_observed + n_surrogate as double)) * (1e0 / n_observed + 1e0 / n_surrogate)), 0), 6) AS z
FROM (
  SELECT ratio, sum(o) AS n_observed, sum(1 - o) AS n_surrogate, sum(o * hit) AS hits_o, sum((1 - o) * hit) AS hits_s,
         sum(o * hit) / nullif(cast(sum(o) as double), 0) AS p_o, sum((1 - o) * hit) / nullif(cast(sum(1 - o) as double), 0) AS p_s
  FROM (SELECT v.ratio, v.o, CASE WHEN NEAR THEN 1 ELSE 0 END AS hit FROM
          (SELECT ratio, value, 1 AS o FROM (OBSERVED) a WHERE value IS NOT NULL UNION ALL SELECT ratio, value, 0 FROM (SURROGATE) b WHERE value IS NOT NULL) v
          JOIN (SELECT ratio, percentile_cont(0.01) WITHIN GROUP (ORDER BY value) AS lo, percentile_cont(0.99) WITHIN GROUP (ORDER BY value) AS hi
                FROM (SELECT ratio, value FROM (OBSERVED) a WHERE value IS NOT NULL UNION ALL SELECT ratio, value FROM (SURROGATE) b WHERE value IS NOT NULL) u GROUP BY ratio) t
          ON t.ratio = v.ratio WHERE v.value BETWEEN t.lo AND t.hi) h GROUP BY ratio) g
WHERE n_observed >= 50 AND n_surrogate >= 50""".replace("NEAR", _NEAR).replace("OBSERVED", RATIOS).replace("SURROGATE", RATIOS.replace("{pivots}", "{others}"))

#: The lifts of all ratios in one figure.
LIFT_MEDIAN = f"SELECT count(*) AS n_ratios, round(median(lift), 6) AS median_lift FROM ({LIFT}) x WHERE lift IS NOT NULL"


def surrogate_sql(block: int = 50, seed: int = 1) -> str:
    """A series put together from blocks of its own log returns, with each bar's spread around its close.

    Blocks begin at scattered places that are the same in every engine; block 0 takes the first bar as it is.
    Opens, highs and lows keep their distance from their bar's close, in proportion.
    """
    place = scattered(f"cast(floor(b.bar_idx / {block}) as bigint) * 104729 + 12345 + {seed * 69069}")
    return f"""
SELECT {KEY}, bar_idx, ts_sec, least(greatest(exp(lc + lo), exp(lc + ll)), exp(lc + lh)) AS open, exp(lc + lh) AS high, exp(lc + ll) AS low, exp(lc) AS close, volume FROM (
  SELECT b.source, b.symbol, b.timeframe, b.bar_idx, b.ts_sec, s.volume,
         first_value(ln(b.close)) OVER v + sum(CASE WHEN b.bar_idx = 0 THEN 0.0 ELSE s.ret END) OVER v AS lc, s.lo, s.lh, s.ll
  FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM {{bars}}) b
  JOIN (SELECT *, coalesce(ln(close) - ln(lag(close) OVER (PARTITION BY {KEY} ORDER BY bar_idx)), 0.0) AS ret,
               ln(open) - ln(close) AS lo, ln(high) - ln(close) AS lh, ln(low) - ln(close) AS ll FROM {{bars}}) s
    ON {on("s", "b")}
    AND s.bar_idx = CASE WHEN b.bar_idx = 0 THEN 0 ELSE 1 + ({place} % greatest(b.n - 1 - {block}, 1) + b.bar_idx % {block}) % (b.n - 1) END
  WINDOW v AS (PARTITION BY b.source, b.symbol, b.timeframe ORDER BY b.bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x"""


def surrogates_sql(draws: int = 3) -> str:
    """Several surrogates of each series, each with a seed and a source of its own."""
    columns = "symbol, timeframe, bar_idx, ts_sec, open, high, low, close, volume"
    return " UNION ALL ".join(f"SELECT concat(source, '/', '{k}') AS source, {columns} FROM ({surrogate_sql(seed=k)}) s{k}" for k in range(1, draws + 1))


def wave_ratios(pivots: DataFrame) -> DataFrame:
    return query(RATIOS, pivots=pivots)


def hit_rate(pivots: DataFrame) -> DataFrame:
    """Per ratio how many values, and which part of them lies within the tolerance of a level."""
    return query(HIT_RATE, pivots=pivots)


def lift(observed: DataFrame, surrogate: DataFrame) -> DataFrame:
    """Hit rates of observed turning points against those of surrogate ones, with z."""
    return query(LIFT, pivots=observed, others=surrogate)


def surrogate(bars: DataFrame, block: int = 50, seed: int = 1) -> DataFrame:
    return query(surrogate_sql(block, seed), bars=bars)
