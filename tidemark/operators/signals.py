"""Confirmation signals, and nine guidelines counted for each."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.plans.frames import KEY, as_of, form, in_block, inside, on, query, spread

#: Scales whose moves give context, how much finer the trigger is, and the bounds of the correction.
CONTEXT, OFFSET = (4, 5, 6), 2
LEAST, MOST, BUFFER = 0.15, 0.95, 0.10

#: The last two points of a scale that are known, with the bars from which and before which they are that: an
#: as-of join with these is a join on the series and an interval.
PAIRS = f"""
SELECT {KEY}, scale, seq, lag(price) OVER w AS p0, lag(idx) OVER w AS i0, price AS p1, idx AS i1, kind AS k1, confirmed_idx AS from_bar, coalesce(lead(confirmed_idx) OVER w, 2147483647) AS to_bar
FROM {{pivots}} WHERE NOT is_anchor WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)"""


_PAIR_COLUMNS = ("seq", "p0", "i0", "p1", "i1", "k1")


def pair_as_of(rows: str, bar: str, scale: str, prefix: str = "c_", *, left: bool = False) -> str:
    """rows with the last two points of a scale that are known at a bar, their columns with a prefix."""
    return as_of(rows, bar, scale, PAIRS, "from_bar", {c: f"{prefix}{c}" for c in _PAIR_COLUMNS}, left=left)


def pairs_at_sql(bar: int) -> str:
    return f"SELECT {KEY}, scale, i0, p0, i1, p1, k1 FROM ({PAIRS}) p WHERE {int(bar)} >= from_bar AND {int(bar)} < to_bar AND p0 IS NOT NULL"


def pairs_at(pivots: DataFrame, bar: int) -> DataFrame:
    """Per series and scale the last two points that are known at a bar."""
    return query(pairs_at_sql(bar), pivots=pivots)


def _corrections(contexts: tuple[int, ...], offset: int) -> str:
    """Points of the finer scale that end a correction of a coarse move, whether or not the move still stands."""
    triggers = f"(SELECT {KEY}, scale, idx, price, kind, confirmed_idx FROM {{pivots}} WHERE NOT is_anchor AND scale + {offset} IN ({', '.join(map(str, contexts))}))"
    return f"""
  SELECT * FROM (
    SELECT {KEY}, confirmed_idx AS bar, CASE WHEN c_p1 > c_p0 THEN 1 ELSE -1 END AS direction, scale + {offset} AS context_scale, scale AS trigger_scale, c_seq AS seq, c_i0 AS i0, c_p0 AS p0, c_i1 AS i1, c_p1 AS p1, idx AS ti, price AS tp, kind AS tk
    FROM {pair_as_of(triggers, "x.confirmed_idx", f"x.scale + {offset}")} t WHERE c_p0 IS NOT NULL AND c_p0 <> c_p1 AND idx > c_i1) s
  WHERE tk = -direction AND abs(tp - p1) / abs(p1 - p0) BETWEEN {LEAST} AND {MOST}"""


def signals_sql(stop: str = "rule", contexts: tuple[int, ...] = CONTEXT, offset: int = OFFSET) -> str:
    """A point of the finer scale becomes known and ends a correction of the coarse move, which still stands.

    stop "rule": at the move's start; "trigger": a tenth of the correction beyond its end, at most the start.
    """
    rule = "p0" if stop == "rule" else f"CASE WHEN direction > 0 THEN greatest(tp - {BUFFER} * abs(tp - p1), p0) ELSE least(tp + {BUFFER} * abs(tp - p1), p0) END"
    return f"""
SELECT {KEY}, bar, direction, context_scale, trigger_scale, seq, i0, p0, i1, p1, ti, tp, {rule} AS stop, abs(tp - p1) / abs(p1 - p0) AS retrace FROM (
  SELECT s.source, s.symbol, s.timeframe, s.bar, s.direction, s.context_scale, s.trigger_scale, s.seq, s.i0, s.p0, s.i1, s.p1, s.ti, s.tp
  FROM {spread(f"({_corrections(contexts, offset)})", "i1", "bar")} s JOIN {{bars}} b ON {on("b", "s")} {in_block("b", "s")} AND b.bar_idx >= s.i1 AND b.bar_idx <= s.bar
  GROUP BY s.source, s.symbol, s.timeframe, s.bar, s.direction, s.context_scale, s.trigger_scale, s.seq, s.i0, s.p0, s.i1, s.p1, s.ti, s.tp
  HAVING max(CASE WHEN s.direction > 0 AND b.low <= s.p0 OR s.direction < 0 AND b.high >= s.p0 THEN 1 ELSE 0 END) = 0) u"""


def signals(bars: DataFrame, pivots: DataFrame, stop: str = "rule", contexts: tuple[int, ...] = CONTEXT, offset: int = OFFSET) -> DataFrame:
    return query(signals_sql(stop, contexts, offset), bars=bars, pivots=pivots)


_ID = f"{KEY}, bar, context_scale"
_SAME = "x.source = s.source AND x.symbol = s.symbol AND x.timeframe = s.timeframe AND x.bar = s.bar AND x.context_scale = s.context_scale"


def _subwaves(a: str, b: str) -> str:
    """The first count of sub-waves of at least 3 on the three finer scales, coarsest first, else the largest.

    Only points that are known at the signal's bar count.
    """
    rows = "(SELECT s.*, f.fine FROM signals s JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS f(fine) ON f.fine < s.context_scale AND f.fine >= s.context_scale - 3)"
    return f"""
SELECT {_ID}, coalesce(max(CASE WHEN n >= 3 AND first_big = fine THEN n END), max(n)) AS n FROM (
  SELECT *, max(CASE WHEN n >= 3 THEN fine END) OVER (PARTITION BY {_ID}) AS first_big FROM (
    SELECT {_ID}, fine, points + 1 AS n FROM {inside(rows, "x.fine", f"x.{a}", f"x.{b}", "x.bar", "points")} i) c) g GROUP BY {_ID}"""


#: How a signal's move compares with the ten moves that end with it. Spark takes them from a window over moves, DuckDB by a join.
_SIZES = form(
    f"""
  SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale, size(filter(m.rels, r -> r IS NOT NULL)) AS n, size(filter(m.rels, r -> abs(s.p1 - s.p0) / s.p0 > r)) / cast(size(m.rels) as double) AS share
  FROM signals s JOIN (
    SELECT {KEY}, scale, seq, transform(collect_list(struct(rel)) OVER (PARTITION BY {KEY}, scale ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), x -> x.rel) AS rels FROM moves) m
  ON {on("m", "s")} AND m.scale = s.context_scale AND m.seq = s.seq""",
    f"""
  SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale, count(m.rel) AS n, avg(CASE WHEN abs(s.p1 - s.p0) / s.p0 > m.rel THEN 1e0 ELSE 0e0 END) AS share
  FROM signals s JOIN moves m ON {on("m", "s")} AND m.scale = s.context_scale AND m.seq <= s.seq AND m.seq > s.seq - 10 GROUP BY s.source, s.symbol, s.timeframe, s.bar, s.context_scale""",
)
_GUIDED = f"""
WITH signals AS ({signals_sql()}),
moves AS (SELECT *, abs(p1 - p0) / nullif(p0, 0) AS rel FROM ({PAIRS}) p WHERE p0 IS NOT NULL),
impulse_waves AS ({_subwaves("i0", "i1")}),
correction_waves AS ({_subwaves("i1", "ti")}),
slices AS (
  SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale,
         avg(CASE WHEN b.bar_idx BETWEEN s.i0 AND s.i1 THEN b.volume END) AS v1, avg(CASE WHEN b.bar_idx BETWEEN s.i1 AND s.ti THEN b.volume END) AS v2,
         max(CASE WHEN b.bar_idx BETWEEN s.i0 AND s.i1 THEN abs(b.macd_hist) END) AS m1, max(CASE WHEN b.bar_idx <= s.i0 THEN abs(b.macd_hist) END) AS m0,
         max(CASE WHEN b.bar_idx = s.i0 THEN b.rsi END) AS rsi0, max(CASE WHEN b.bar_idx = s.ti THEN b.rsi END) AS rsi1, max(CASE WHEN b.bar_idx = s.bar THEN b.close END) AS close
  FROM {spread("signals", "greatest(0, i0 - greatest(i1 - i0, 1))", "bar")} s JOIN {{ind}} b ON {on("b", "s")} {in_block("b", "s")} AND b.bar_idx >= greatest(0, s.i0 - greatest(s.i1 - s.i0, 1)) AND b.bar_idx <= s.bar
  GROUP BY s.source, s.symbol, s.timeframe, s.bar, s.context_scale),
higher AS (SELECT {_ID}, h_p1 AS price, h_k1 AS kind FROM {pair_as_of("signals", "x.bar", "x.context_scale + 1", "h_")} h),
sizes AS ({_SIZES})"""
_GUIDED_FROM = f"""
FROM signals s JOIN impulse_waves a ON {_SAME.replace("x.", "a.")} JOIN correction_waves c ON {_SAME.replace("x.", "c.")} JOIN slices x ON {_SAME}
LEFT JOIN higher h ON {_SAME.replace("x.", "h.")} LEFT JOIN sizes z ON {_SAME.replace("x.", "z.")}"""
#: Nine booleans for each signal.
GUIDELINES = f"""{_GUIDED}
SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale, s.direction,
       a.n IN (5, 9, 13) AS impulse_divides, c.n IN (3, 7, 11) AS correction_divides, s.retrace BETWEEN 0.35 AND 0.80 AS typical_retrace, s.ti - s.i1 <= greatest(s.i1 - s.i0, 1) AS shorter,
       coalesce(x.v1 > 0 AND x.v2 < x.v1, false) AS volume_contracts, coalesce(x.m0 > 0 AND x.m1 > x.m0, false) AS momentum,
       coalesce(CASE WHEN s.direction > 0 THEN s.tp < 1.02 * s.p0 AND x.rsi1 > x.rsi0 ELSE s.tp > 0.98 * s.p0 AND x.rsi1 < x.rsi0 END, false) AS divergence,
       coalesce(CASE WHEN h.kind < 0 AND x.close > h.price THEN 1 WHEN h.kind > 0 AND x.close < h.price THEN -1 ELSE 0 END = s.direction, false) AS higher_agrees,
       coalesce(z.n >= 5 AND z.share >= 0.6, false) AS significant{_GUIDED_FROM}"""
#: The nine numbers on which they rest; null where there is nothing to compare with.
GUIDELINE_VALUES = f"""{_GUIDED}
SELECT s.source, s.symbol, s.timeframe, s.bar, s.context_scale, s.direction,
       a.n AS impulse_waves, c.n AS correction_waves, round(s.retrace, 8) AS retrace,
       round((s.ti - s.i1) / cast(greatest(s.i1 - s.i0, 1) as double), 8) AS time_ratio,
       round(CASE WHEN x.v1 > 0 THEN x.v2 / x.v1 END, 6) AS volume_ratio,
       round(CASE WHEN x.m0 > 0 THEN x.m1 / x.m0 END, 5) AS momentum_ratio, round(x.rsi1, 6) AS rsi_at_end,
       CASE WHEN h.kind IS NULL THEN NULL WHEN h.kind < 0 AND x.close > h.price THEN 1
            WHEN h.kind > 0 AND x.close < h.price THEN -1 ELSE 0 END AS higher_direction,
       round(CASE WHEN z.n >= 5 THEN z.share END, 6) AS size_percentile{_GUIDED_FROM}"""

NAMES = ("impulse_divides", "correction_divides", "typical_retrace", "shorter", "volume_contracts", "momentum", "divergence", "higher_agrees", "significant")
SCORES = f"SELECT {KEY}, bar, context_scale, direction, {' + '.join(f'cast({n} as int)' for n in NAMES)} AS score FROM ({GUIDELINES}) g"
SUMMARY = f"SELECT context_scale, count(*) AS n, {', '.join(f'cast(sum(cast({n} as int)) as bigint) AS {n}' for n in NAMES)} FROM ({GUIDELINES}) g GROUP BY context_scale"


def guidelines(bars_with_indicators: DataFrame, pivots: DataFrame) -> DataFrame:
    """Per signal which guidelines it meets; nothing that is known only later is read."""
    return query(GUIDELINES.replace("{bars}", "{ind}"), ind=bars_with_indicators, pivots=pivots)


def guideline_values(bars_with_indicators: DataFrame, pivots: DataFrame) -> DataFrame:
    return query(GUIDELINE_VALUES.replace("{bars}", "{ind}"), ind=bars_with_indicators, pivots=pivots)
