"""Labelings: which patterns the windows of consecutive turning points fit, and how well they divide."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import rules
from tidemark.plans.frames import KEY, on, query

KEEP = f"{KEY}, scale, seq, p0, p1, p2, p3, p4, p5, p6, p7, i0, i1, i2, i3, i4, i5, i6, i7, c0, c1, c2, c3, c4, c5, c6, c7"
_LAST = {name: len(waves) for name, waves in rules.PATTERNS.items()}
_END = "CASE " + " ".join(f"WHEN pattern = '{name}' THEN i{n}" for name, n in _LAST.items()) + " END"
_KNOWN = "CASE " + " ".join(f"WHEN pattern = '{name}' THEN greatest({', '.join(f'c{k}' for k in range(n + 1))})" for name, n in _LAST.items()) + " END"
_WAVES = "(VALUES " + ", ".join(f"('{name}', {i}, {e})" for name, waves in rules.PATTERNS.items() for i, e in enumerate(waves)) + ") AS e(pattern, wave, expected)"

LABELINGS = f"""
SELECT {KEEP}, pattern, notes, i0 AS start_idx, {_END} AS end_idx, {_KNOWN} AS known_idx
FROM ({rules.check_sql("(" + rules.window_sql("{pivots}") + ")", KEEP, exact=False)}) AS c WHERE ok"""

#: Points of each of the three finer scales within every move of a scale: one window instead of a range join.
INNER = f"""
SELECT {KEY}, coarse, fine, seg AS seq, count(*) AS points FROM (
  SELECT *, max(cseq) OVER (PARTITION BY {KEY}, coarse, fine ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg,
         max(CASE WHEN cseq IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY}, coarse, fine, idx) AS on_coarse
  FROM (
    SELECT {KEY}, scale AS coarse, scale - o AS fine, seq AS cseq, idx FROM {{pivots}} CROSS JOIN (VALUES (1), (2), (3)) AS t(o) WHERE NOT is_anchor AND scale - o >= 0
    UNION ALL
    SELECT {KEY}, scale + o AS coarse, scale AS fine, CAST(NULL AS INT) AS cseq, idx FROM {{pivots}} CROSS JOIN (VALUES (1), (2), (3)) AS t(o) WHERE scale + o <= 7) u) v
WHERE cseq IS NULL AND on_coarse = 0 AND seg IS NOT NULL GROUP BY {KEY}, coarse, fine, seg"""

SUBSTRUCTURE = f"""
SELECT {KEY}, scale, seq, pattern, round(avg(CASE WHEN expected = 5 AND n IN (5, 9, 13) OR expected = 3 AND n IN (3, 7, 11) THEN 1e0 ELSE 0e0 END), 6) AS substructure, cast(sum(n) as bigint) AS subwaves FROM (
  SELECT l.source, l.symbol, l.timeframe, l.scale, l.seq, l.pattern, e.wave, e.expected, CASE WHEN f.fine IS NULL THEN 0 ELSE coalesce(i.points, 0) + 1 END AS n,
         row_number() OVER (PARTITION BY l.source, l.symbol, l.timeframe, l.scale, l.seq, l.pattern, e.wave ORDER BY abs(coalesce(i.points, 0) + 1 - e.expected), f.fine DESC) AS best
  FROM ({LABELINGS}) l JOIN {_WAVES} ON l.pattern = e.pattern
  LEFT JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) AS f(fine) ON f.fine < l.scale AND f.fine >= l.scale - 3
  LEFT JOIN ({INNER}) i ON i.source = l.source AND i.symbol = l.symbol AND i.timeframe = l.timeframe AND i.coarse = l.scale AND i.fine = f.fine AND i.seq = l.seq + e.wave) w
WHERE best = 1 GROUP BY {KEY}, scale, seq, pattern"""

BY_PATTERN = f"SELECT {KEY}, scale, pattern, count(*) AS n FROM ({LABELINGS}) l GROUP BY {KEY}, scale, pattern"


def labelings(pivots: DataFrame) -> DataFrame:
    """Every pattern that every window fits; ambiguity is part of the result."""
    return query(LABELINGS, pivots=pivots)


def labelings_at(pivots: DataFrame, bar: int) -> DataFrame:
    """Those that were known at a bar."""
    return query(as_of_sql(bar), pivots=pivots)


def as_of_sql(bar: int) -> str:
    return f"SELECT {KEY}, scale, seq, pattern, notes, start_idx, end_idx, known_idx FROM ({LABELINGS}) l WHERE known_idx <= {int(bar)}"


def substructure(pivots: DataFrame) -> DataFrame:
    """Per labeling the share of its waves that divide, on one of three finer scales, into as many as they should."""
    return query(SUBSTRUCTURE, pivots=pivots)


def hypotheses_sql(bar: int, overlap: float = 0.0) -> str:
    """Impulses in progress at a bar: after wave 2 the third is next, after wave 4 the fifth; with the price that ends each."""
    last = ", ".join(f"lag({c}, {k}) OVER w AS {a}{k}" for k in range(1, 5) for c, a in (("price", "p"), ("idx", "i")))
    seen = f"SELECT *, row_number() OVER (PARTITION BY {KEY}, scale ORDER BY seq DESC) AS r FROM (SELECT {KEY}, scale, seq, price AS p0, idx AS i0, {last} FROM {{pivots}} WHERE NOT is_anchor AND confirmed_idx <= {int(bar)} WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)) x"
    # p0 is the newest point, p4 the oldest
    d3, d5 = "(CASE WHEN p1 > p2 THEN 1 ELSE -1 END)", "(CASE WHEN p3 > p4 THEN 1 ELSE -1 END)"
    return f"""
SELECT {KEY}, scale, 3 AS next_wave, {d3} AS direction, p2 AS invalidation, i2 AS start_idx FROM ({seen}) s
WHERE r = 1 AND p2 IS NOT NULL AND {d3} * (p0 - p2) > 0 AND p1 <> p2
UNION ALL
SELECT {KEY}, scale, 5, {d5}, p3, i4 FROM ({seen}) s
WHERE r = 1 AND p4 IS NOT NULL AND {d5} * (p2 - p4) > 0 AND {d5} * (p1 - p3) > 0 AND {d5} * (p0 - p2) > 0 AND p3 <> p4 AND {d5} * (p3 - p0) / nullif(abs(p3 - p4), 0) <= {overlap}"""


def hypotheses(pivots: DataFrame, bar: int, overlap: float = 0.0) -> DataFrame:
    return query(hypotheses_sql(bar, overlap), pivots=pivots)


def alive_sql(bar: int) -> str:
    """Hypotheses of a bar with whether the bar itself leaves them standing (strictly)."""
    return f"""
SELECT h.source, h.symbol, h.timeframe, h.scale, h.next_wave, h.direction, CASE WHEN h.direction > 0 THEN b.low > h.invalidation ELSE b.high < h.invalidation END AS alive
FROM ({hypotheses_sql(bar)}) h JOIN {{bars}} b ON b.source = h.source AND b.symbol = h.symbol AND b.timeframe = h.timeframe AND b.bar_idx = {int(bar)}"""


#: Hypotheses of bar 400 as they are placed on a stream, and, for checking, the first later bar that ends each.
PLACED = f"""
SELECT h.source, h.symbol, h.timeframe, h.scale, h.next_wave, h.direction, 400 AS bar, concat_ws('|', h.source, h.symbol, h.timeframe, cast(h.scale as string), cast(h.next_wave as string)) AS id,
       h.invalidation AS dead, cast(NULL as double) AS limit_price, cast(NULL as int) AS expiry_bar, b.ts_sec, cast(NULL as bigint) AS deadline_sec
FROM ({hypotheses_sql(400)}) h JOIN {{bars}} b ON {on("b", "h")} AND b.bar_idx = 400"""
INVALID = f"""
SELECT h.source, h.symbol, h.timeframe, h.scale, h.next_wave, h.direction, min(CASE WHEN h.direction > 0 AND b.low <= h.invalidation OR h.direction < 0 AND b.high >= h.invalidation THEN b.bar_idx END) AS invalid_bar
FROM ({hypotheses_sql(400)}) h JOIN {{bars}} b ON {on("b", "h")} AND b.bar_idx > 400
WHERE EXISTS (SELECT 1 FROM {{bars}} x WHERE {on("x", "h")} AND x.bar_idx = 400) GROUP BY h.source, h.symbol, h.timeframe, h.scale, h.next_wave, h.direction"""
