"""What is wrong with bars: one row for each series and kind of issue, with how often it occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.plans.frames import KEY, query

#: Ratios of open to the close before that hint at an unadjusted split, and how near counts.
SPLITS = (2.0, 3.0, 4.0, 5.0, 10.0, 20.0, 1.5, 1.25)
NEAR, TOLERANCE, FLAT_RUN = 0.02, 1e-9, 5
_STEP = "CASE timeframe WHEN '15m' THEN 900 WHEN '1h' THEN 3600 WHEN '4h' THEN 14400 WHEN '1d' THEN 86400 WHEN '1w' THEN 604800 END"
_RATIOS = [x for s in SPLITS for x in (s, 1 / s)]
_SPLIT = "(r <= 0.9 OR r >= 1.1) AND (" + " OR ".join(f"abs(r - {x!r}) / {x!r} < {NEAR}" for x in _RATIOS) + ")"

#: raw: bars in the order of ingest_seq, duplicates and all. Prices that are NaN must have become null before.
MARKED = f"""
SELECT *, close = pc AND high = low AS flat, ts_sec - pts AS gap, open / nullif(pc, 0) AS r, ts_sec < arrived_before AS late, {_STEP} AS step
FROM (SELECT *, lag(close) OVER w AS pc, lag(ts_sec) OVER w AS pts, lag(ts_sec) OVER (PARTITION BY {KEY} ORDER BY ingest_seq) AS arrived_before,
             row_number() OVER (PARTITION BY {KEY}, ts_sec ORDER BY ingest_seq DESC) AS copy
      FROM {{raw}} WINDOW w AS (PARTITION BY {KEY} ORDER BY ts_sec, ingest_seq)) m"""

#: Lengths of runs of unchanged closes without any range.
FLATLINES = f"""
SELECT {KEY}, min(ts_sec) AS from_sec, count(*) AS bars FROM (
  SELECT *, sum(CASE WHEN coalesce(flat, false) THEN 0 ELSE 1 END) OVER (PARTITION BY {KEY} ORDER BY ts_sec, ingest_seq) AS run FROM ({MARKED}) a) b
WHERE flat GROUP BY {KEY}, run HAVING count(*) >= {FLAT_RUN}"""

_COUNTS = {
    "INDEX_UNSORTED": ("ERROR", "late"), "INDEX_DUPES": ("ERROR", "copy > 1"),
    "OHLC_INCONSISTENT": ("ERROR", f"high < greatest(open, close, low) - {TOLERANCE} OR low > least(open, close, high) + {TOLERANCE}"),
    "NONPOSITIVE_PRICE": ("ERROR", "least(open, high, low, close) <= 0"), "NAN": ("ERROR", "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL"),
    "GAPS": ("WARN", "gap > 1.5 * step"), "SUBSTEP": ("ERROR", "gap > 0 AND gap < 0.5 * step"), "POSSIBLE_SPLIT": ("WARN", _SPLIT), "EXTREME_JUMP": ("WARN", "r > 2 OR r < 0.5"),
}
_SUMS = ", ".join(f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS {code.lower()}" for code, (_, cond) in _COUNTS.items())
_ROWS = " UNION ALL ".join(f"SELECT {KEY}, '{sev}' AS severity, '{code}' AS code, {code.lower()} AS n FROM counted WHERE {code.lower()} > 0" for code, (sev, _) in _COUNTS.items())
ISSUES = f"""
WITH counted AS (SELECT {KEY}, {_SUMS} FROM ({MARKED}) a GROUP BY {KEY})
{_ROWS} UNION ALL SELECT {KEY}, 'WARN', 'FLATLINE', max(bars) FROM ({FLATLINES}) f GROUP BY {KEY}"""

VERDICT = f"SELECT {KEY}, sum(CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END) AS errors, sum(CASE WHEN severity = 'WARN' THEN 1 ELSE 0 END) AS warnings, sum(CASE WHEN severity = 'ERROR' THEN 1 ELSE 0 END) = 0 AS ok FROM ({ISSUES}) i GROUP BY {KEY}"
WORST_GAPS = f"SELECT {KEY}, ts_sec, gap FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY gap DESC, ts_sec) AS worst FROM ({MARKED}) a WHERE gap > 1.5 * step) b WHERE worst <= 3"
SPLIT_DAYS = f"SELECT {KEY}, ts_sec, round(r, 6) AS ratio FROM ({MARKED}) a WHERE {_SPLIT}"

#: The first three bars of each kind of issue, in order of time.
EXAMPLES = f"""
SELECT {KEY}, code, nth, ts_sec FROM (
  SELECT {KEY}, code, ts_sec, row_number() OVER (PARTITION BY {KEY}, code ORDER BY ts_sec, ingest_seq) AS nth
  FROM ({MARKED}) a CROSS JOIN (VALUES {", ".join(f"('{code}')" for code in _COUNTS)}) AS c(code)
  WHERE CASE code {" ".join(f"WHEN '{code}' THEN {cond}" for code, (_, cond) in _COUNTS.items())} END) e
WHERE nth <= 3"""


def examples(raw: DataFrame) -> DataFrame:
    return query(EXAMPLES, raw=raw)


def issues(raw: DataFrame) -> DataFrame:
    return query(ISSUES, raw=raw)


def verdict(raw: DataFrame) -> DataFrame:
    """Per series with any issue: errors, warnings, and whether it is fit for use (no error)."""
    return query(VERDICT, raw=raw)


#: Bars with arithmetic dirt, for tests and the registered queries: duplicates, late rows, broken and flat bars.
DIRTY = f"""
SELECT {KEY}, ts_sec, bar_idx * 10 + CASE WHEN bar_idx % 211 = 7 THEN 25 ELSE 0 END AS ingest_seq, CASE WHEN bar_idx % 301 = 11 THEN open * 2 ELSE open END AS open,
       CASE WHEN bar_idx % 97 = 5 THEN low - 1 WHEN bar_idx % 100 > 90 THEN 500.0 ELSE high END AS high, CASE WHEN bar_idx % 100 > 90 THEN 500.0 ELSE low END AS low,
       CASE WHEN bar_idx % 100 > 90 THEN 500.0 WHEN bar_idx % 503 = 3 THEN NULL ELSE close END AS close, volume
FROM {{bars}}
UNION ALL SELECT {KEY}, ts_sec, bar_idx * 10 + 5, open, high, low, close + 1, volume FROM {{bars}} WHERE bar_idx % 53 = 2
UNION ALL SELECT {KEY}, ts_sec + 60, bar_idx * 10 + 6, open, high, low, close, volume FROM {{bars}} WHERE bar_idx % 401 = 9"""
