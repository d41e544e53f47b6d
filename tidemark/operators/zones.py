"""Target zones of corrections, limit orders into them, and what becomes of the orders.

A zone is a closed range of prices. Bands are parts of a move that a correction gives back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import hits
from tidemark.operators.signals import CONTEXT, PAIRS, pair_as_of
from tidemark.operators.turns import with_turns
from tidemark.plans.frames import KEY, as_of, form, in_block, on, query, scattered, spread

#: The bands, the target's and the pending leg's ratios, the stop's distance, how long orders wait.
NEAR, MID, FAR = 0.382, 0.618, 1.0
EXTENSION, EQUAL, FIFTH = 1.618, 1.0, 0.618
STOP, LEAST_RR, WAIT, WAIT_SUB = 0.01, 2.0, 60, 40
CANONICAL = (2, 3, 6, 7, 10, 11)
_SCALES, _CANONICAL = ", ".join(map(str, CONTEXT)), ", ".join(map(str, CANONICAL))

#: Coarse moves with both points, and their direction.
_MOVES = f"SELECT *, CASE WHEN p1 > p0 THEN 1 ELSE -1 END AS d FROM ({PAIRS}) m WHERE p0 IS NOT NULL AND p0 <> p1"
#: Finer points of up to four scales below a move, known before the next move's end is: each belongs to the move that is the last known at its own
#: time, and to later ones that ended before it (as they become known later). Spark finds both ends of that run of moves by as-of joins.
_MEMBERS = "e.fine, e.eseq, e.idx, e.kind, e.price, e.known"
_FINE = f"(SELECT {KEY}, scale AS fine, seq AS eseq, idx, kind, price, confirmed_idx AS known, scale + o AS coarse FROM {{pivots}} CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(o) WHERE NOT is_anchor AND scale + o IN ({_SCALES}))"
_LAST_ENDED = as_of(as_of(_FINE, "x.known", "x.coarse", PAIRS, "from_bar", {"seq": "from_seq"}, left=True), "x.idx", "x.coarse", PAIRS, "i1", {"seq": "to_seq"}, strict=True)
_BELONG = form(
    f"""
  SELECT c.source, c.symbol, c.timeframe, c.scale, c.seq, {_MEMBERS}
  FROM moves c JOIN (SELECT *, explode(sequence(coalesce(from_seq, 0), to_seq)) AS of_seq FROM {_LAST_ENDED} b WHERE coalesce(from_seq, 0) <= to_seq) e
  ON {on("e", "c")} AND e.coarse = c.scale AND e.of_seq = c.seq""",
    f"""
  SELECT c.source, c.symbol, c.timeframe, c.scale, c.seq, {_MEMBERS}
  FROM moves c JOIN {_FINE} e ON {on("e", "c")} AND e.coarse = c.scale AND e.idx > c.i1 AND e.known < c.to_bar""",
)
#: As they become known: the n-th leg of the correction, with the two ends before.
_LEGS = f"""
SELECT *, row_number() OVER w AS n, lag(price, 1) OVER w AS before1, lag(price, 2) OVER w AS before2, first_value(price) OVER w AS first_price, coalesce(lead(known) OVER w, 2147483647) AS until FROM ({_BELONG}) l
WINDOW w AS (PARTITION BY {KEY}, scale, seq, fine ORDER BY eseq)"""
_PAIR = "x.source = o.source AND x.symbol = o.symbol AND x.timeframe = o.timeframe AND x.scale = o.scale AND x.seq = o.seq"


def overlap(lo: str, hi: str) -> str:
    """The part of the order's own zone that another covers."""
    return f"(greatest(least(zone_hi, {hi}) - greatest(zone_lo, {lo}), 0e0) / nullif(zone_hi - zone_lo, 0))"


def _lo(a: str, b: str) -> str:
    return f"least({a}, {b})"


#: An order at the bar at which a move's end becomes known, unless price has come too near; with its projections.
_ORDERS = f"""
WITH moves AS ({_MOVES}), legs AS ({_LEGS}),
set_up AS (
  SELECT o.*, p1 - CASE WHEN extended THEN {MID} ELSE {NEAR} END * (p1 - p0) AS near_edge, p1 - CASE WHEN extended THEN {FAR} ELSE {MID} END * (p1 - p0) AS far_edge FROM (
    SELECT m.source, m.symbol, m.timeframe, m.scale, m.seq, m.from_bar AS bar, m.d AS direction, m.i0, m.p0, m.i1, m.p1, m.k1, b.close,
           NOT EXISTS (SELECT 1 FROM legs x WHERE {_PAIR.replace("o.", "m.")} AND x.fine >= m.scale - 2 AND x.known <= m.from_bar AND x.n >= 3) AS extended
    FROM moves m JOIN {{bars}} b ON {on("b", "m")} AND b.bar_idx = m.from_bar WHERE m.scale IN ({_SCALES})) o
  WHERE direction * (close - (p1 - {NEAR} * (p1 - p0))) >= 0),
priced AS (
  SELECT *, near_edge AS limit_price, STOP_EDGE * (1 - {STOP} * direction) AS stop, far_edge + {EXTENSION} * (p1 - p0) AS target, least(near_edge, far_edge) AS zone_lo, greatest(near_edge, far_edge) AS zone_hi FROM set_up),
prior AS (
  SELECT {KEY}, scale, idx, kind, least(a, b, c, d) AS e1, greatest(a, b, c, d) AS e2 FROM (
    SELECT {KEY}, scale, idx, kind, lag(price, 1) OVER w AS a, lag(price, 2) OVER w AS b, lag(price, 3) OVER w AS c, lag(price, 4) OVER w AS d FROM {{pivots}} WHERE NOT is_anchor
    WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)) q WHERE d IS NOT NULL),
projected AS (
  SELECT o.*, h_p1 - {NEAR} * (h_p1 - h_p0) AS h1, h_p1 - {MID} * (h_p1 - h_p0) AS h2, x.price - o.direction * abs(x.first_price - o.p1) AS x1, x.price - o.direction * {EXTENSION} * abs(x.first_price - o.p1) AS x2, e.e1, e.e2,
         row_number() OVER (PARTITION BY o.source, o.symbol, o.timeframe, o.scale, o.seq ORDER BY x.fine DESC) AS best
  FROM {pair_as_of("priced", "x.bar", "x.scale + 1", "h_", left=True)} o
  LEFT JOIN legs x ON {_PAIR} AND x.fine >= o.scale - 3 AND x.known <= o.bar AND x.until > o.bar AND x.n >= 2 AND x.first_price <> o.p1
  -- a move's end is a point of the finer scale too, so what came before it stands beside it there
  LEFT JOIN prior e ON {on("e", "o")} AND e.scale = o.scale - 1 AND e.idx = o.i1 AND e.kind = o.k1),
supported AS (
  SELECT *, {overlap(_lo("h1", "h2"), "greatest(h1, h2)")} AS by_higher, {overlap(_lo("x1", "x2"), "greatest(x1, x2)")} AS by_inner, {overlap("e1", "e2")} AS by_earlier FROM projected WHERE best = 1)
SELECT {KEY}, bar, direction, scale AS context_scale, i0, p0, i1, p1, limit_price, stop, target, extended, bar + {WAIT} AS expiry_bar, abs(target - limit_price) / abs(limit_price - stop) AS rr,
       CASE WHEN by_higher > 0.1 THEN 1 ELSE 0 END + CASE WHEN by_inner > 0.1 THEN 1 ELSE 0 END + CASE WHEN by_earlier > 0.1 THEN 1 ELSE 0 END AS n_supporting, coalesce(by_higher, 0e0) + coalesce(by_inner, 0e0) + coalesce(by_earlier, 0e0) AS confluence
FROM supported WHERE abs(target - limit_price) / nullif(abs(limit_price - stop), 0) >= {LEAST_RR}"""



def orders_sql(stop_from: str = "operative") -> str:
    """stop_from: the far edge of the zone in use ("operative"), or always that of the deeper zone ("extended")."""
    return _ORDERS.replace("STOP_EDGE", {"operative": "far_edge", "extended": f"(p1 - {FAR} * (p1 - p0))"}[stop_from])


ORDERS = orders_sql()

#: Moves with the last bar before the next one's end is known.
_LASTING = f"(SELECT m.*, least(m.to_bar, n.n_bars) - 1 AS last_bar FROM moves m JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{bars}} GROUP BY {KEY}) n ON {on('n', 'm')} WHERE m.scale IN ({_SCALES}))"
#: How the correction that is running at each bar divides, on the coarsest finer scale with a corrective count, else on the coarsest with two legs.
DECOMPOSED = f"""
WITH moves AS ({_MOVES}), legs AS ({_LEGS}),
state AS (
  SELECT m.source, m.symbol, m.timeframe, m.scale, m.seq, m.d, m.i0, m.p0, m.i1, m.p1, m.from_bar, b.bar_idx AS bar, b.close, min(b.low) OVER w AS lowest, max(b.high) OVER w AS highest
  FROM {spread(_LASTING, "i1", "last_bar")} m JOIN {{bars}} b ON {on("b", "m")} {in_block("b", "m")} AND b.bar_idx >= m.i1 AND b.bar_idx < m.to_bar
  WINDOW w AS (PARTITION BY m.source, m.symbol, m.timeframe, m.scale, m.seq ORDER BY b.bar_idx)),
divided AS (
  SELECT o.*, x.fine, x.n AS legs, x.idx AS last_idx, x.kind AS last_kind, x.price AS last_price, x.before1, CASE WHEN x.n = 2 THEN o.p1 ELSE x.before2 END AS before2,
         row_number() OVER (PARTITION BY o.source, o.symbol, o.timeframe, o.scale, o.bar ORDER BY CASE WHEN x.n IN ({_CANONICAL}) THEN 0 ELSE 1 END, x.fine DESC) AS best
  FROM state o JOIN legs x ON {_PAIR} AND o.bar >= x.known AND o.bar < x.until
  WHERE o.bar >= o.from_bar AND NOT (o.d > 0 AND o.lowest <= o.p0 OR o.d < 0 AND o.highest >= o.p0) AND x.n >= 2)
SELECT * FROM divided WHERE best = 1"""

_LABEL = f"CASE WHEN legs NOT IN ({_CANONICAL}) THEN 'open' WHEN legs <= 3 THEN 'simple' WHEN legs <= 7 THEN 'double_three' ELSE 'triple_three' END"
DECOMPOSITIONS = f"SELECT {KEY}, scale AS context_scale, {_LABEL} AS label, count(*) AS bars FROM ({DECOMPOSED}) d GROUP BY {KEY}, scale, {_LABEL}"

#: Orders where at least two of three projections of the correction's end meet; one for each correction.
SUB_ORDERS = f"""
WITH divided AS (SELECT * FROM ({DECOMPOSED}) d WHERE legs IN ({_CANONICAL})),
ahead AS (SELECT {KEY}, scale, idx, kind, price AS j0, lead(price, 1) OVER w AS j1, lead(price, 4) OVER w AS j4, lead(confirmed_idx, 4) OVER w AS known4 FROM {{pivots}} WHERE NOT is_anchor WINDOW w AS (PARTITION BY {KEY}, scale ORDER BY seq)),
fifth AS (
  SELECT source, symbol, timeframe, scale, bar, j4 + CASE WHEN j1 > j0 THEN 1 ELSE -1 END * {FIFTH} * abs(j1 - j0) AS e1, j4 + CASE WHEN j1 > j0 THEN 1 ELSE -1 END * {EQUAL} * abs(j1 - j0) AS e2 FROM (
    SELECT v.source, v.symbol, v.timeframe, v.scale, v.bar, a.j0, a.j1, a.j4, row_number() OVER (PARTITION BY v.source, v.symbol, v.timeframe, v.scale, v.bar ORDER BY a.scale DESC) AS best
    FROM divided v JOIN ahead a ON {on("a", "v")} AND a.idx = v.last_idx AND a.kind = v.last_kind AND a.scale < v.fine AND a.scale >= v.fine - 2 WHERE a.known4 <= v.bar AND a.j1 <> a.j0) f WHERE best = 1),
zoned AS (
  SELECT z.*, greatest(least(q1, q2), least(e1, e2), least(b1, b2)) AS zone_lo, least(greatest(q1, q2), greatest(e1, e2), greatest(b1, b2)) AS zone_hi,
         1 + CASE WHEN q1 IS NULL THEN 0 ELSE 1 END + CASE WHEN e1 IS NULL THEN 0 ELSE 1 END AS n_projections FROM (
    SELECT v.*, f.e1, f.e2, CASE WHEN before1 <> before2 THEN last_price + (before1 - before2) * {EQUAL} END AS q1, CASE WHEN before1 <> before2 THEN last_price + (before1 - before2) * {EXTENSION} END AS q2,
           p1 - CASE WHEN deep THEN {MID} ELSE {NEAR} END * (p1 - p0) AS b1, p1 - CASE WHEN deep THEN {FAR} ELSE {MID} END * (p1 - p0) AS b2
    FROM (SELECT *, abs(CASE WHEN d > 0 THEN lowest ELSE highest END - p1) / abs(p1 - p0) > {MID} AS deep FROM divided) v LEFT JOIN fifth f ON {on("f", "v")} AND f.scale = v.scale AND f.bar = v.bar) z),
priced AS (SELECT *, CASE WHEN d > 0 THEN zone_hi ELSE zone_lo END AS limit_price, p0 * (1 - {STOP} * d) AS stop, p0 + {EXTENSION} * (p1 - p0) AS target FROM zoned WHERE n_projections >= 2 AND zone_hi > zone_lo)
SELECT {KEY}, bar, d AS direction, scale AS context_scale, i0, p0, i1, p1, limit_price, stop, target, deep AS extended, bar + {WAIT_SUB} AS expiry_bar, abs(target - limit_price) / abs(limit_price - stop) AS rr, n_projections AS n_supporting, cast(legs as double) AS confluence FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEY}, scale, i1 ORDER BY bar) AS first_of_move FROM priced
  WHERE d * (close - limit_price) > 0 AND abs(target - limit_price) / nullif(abs(limit_price - stop), 0) >= {LEAST_RR}) g WHERE first_of_move = 1"""


_ORDER = "source, symbol, timeframe, bar, context_scale, direction, limit_price, stop, target, n_supporting, extended"
_FAR = 2147483647


def _filled_sql(orders: str, missed: float = 1.0) -> str:
    """Orders with status, fill_bar, fill and the series' n_bars.

    Filled at the open where that is beyond the limit already.
    """
    cols = ", ".join(f"o.{c}" for c in (*_ORDER.split(", "), "n_bars"))
    return f"""
WITH placed AS (SELECT o.*, p1 + direction * {missed} * abs(p1 - p0) AS gone, n.n_bars FROM ({orders}) o JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{bars}} GROUP BY {KEY}) n ON {on("n", "o")}),
met AS (
  SELECT {cols}, coalesce(min(CASE WHEN o.direction > 0 AND b.high >= o.gone OR o.direction < 0 AND b.low <= o.gone THEN b.bar_idx END), {_FAR}) AS t_gone,
         coalesce(min(CASE WHEN o.direction > 0 AND b.low <= o.limit_price OR o.direction < 0 AND b.high >= o.limit_price THEN b.bar_idx END), {_FAR}) AS t_touch
  FROM {spread("placed", "bar", "least(expiry_bar, n_bars - 1)")} o LEFT JOIN {{bars}} b ON {on("b", "o")} {in_block("b", "o")} AND b.bar_idx > o.bar AND b.bar_idx <= o.expiry_bar GROUP BY {cols})
SELECT o.*, CASE WHEN o.t_touch < o.t_gone THEN 'filled' WHEN o.t_gone < {_FAR} THEN 'missed' ELSE 'expired' END AS status, CASE WHEN o.t_touch < o.t_gone THEN o.t_touch END AS fill_bar,
       CASE WHEN o.t_touch < o.t_gone THEN CASE WHEN o.direction * (b.open - o.limit_price) <= 0 THEN b.open ELSE o.limit_price END END AS fill
FROM met o LEFT JOIN {{bars}} b ON {on("b", "o")} AND b.bar_idx = o.t_touch"""


def _ended_sql(ended: str, per_side: float, gap_stop_at_open: bool) -> str:
    """The trades of orders with reason and exit_bar."""
    at_stop = "CASE WHEN o.direction > 0 THEN least(o.stop, x.open) ELSE greatest(o.stop, x.open) END" if gap_stop_at_open else "o.stop"
    left_at = f"CASE o.reason WHEN 'stop' THEN {at_stop} WHEN 'target' THEN o.target WHEN 'open' THEN x.close END"
    return f"""
SELECT o.source, o.symbol, o.timeframe, o.bar, o.context_scale, o.context_scale AS trigger_scale, o.direction, o.status, o.fill_bar AS entry_bar, CASE WHEN o.reason IS NOT NULL THEN x.bar_idx END AS exit_bar, o.fill AS entry,
       {left_at} AS exit, o.stop, o.reason, o.n_supporting, o.extended,
       (({left_at} - o.fill) * o.direction - (o.fill + {left_at}) * {per_side}) / nullif(abs(o.fill - o.stop), 0) AS r
FROM {ended} o LEFT JOIN {{bars}} x ON {on("x", "o")} AND x.bar_idx = o.exit_bar"""


def fates_sql(orders: str, per_side: float = 0.001, missed: float = 1.0, gap_stop_at_open: bool = False) -> str:
    """Every order as if it were alone: missed, expired or filled, and the trade of a filled one; by all later bars of each, for checking."""
    stopped = "o.direction > 0 AND b.low <= o.stop OR o.direction < 0 AND b.high >= o.stop"
    reached = "o.direction > 0 AND b.high >= o.target OR o.direction < 0 AND b.low <= o.target"
    return f"""
WITH filled AS ({_filled_sql(orders, missed)}),
hits AS (
  SELECT o.source, o.symbol, o.timeframe, o.bar, o.context_scale, coalesce(min(CASE WHEN {stopped} THEN b.bar_idx END), {_FAR}) AS t_stop, coalesce(min(CASE WHEN {reached} THEN b.bar_idx END), {_FAR}) AS t_target
  FROM filled o JOIN {{bars}} b ON {on("b", "o")} AND b.bar_idx >= o.fill_bar GROUP BY o.source, o.symbol, o.timeframe, o.bar, o.context_scale),
reasoned AS (
  SELECT o.*, h.t_stop, h.t_target, CASE WHEN fill IS NULL OR fill = stop THEN NULL WHEN t_stop <= t_target AND t_stop < {_FAR} THEN 'stop' WHEN t_target < {_FAR} THEN 'target' ELSE 'open' END AS reason
  FROM filled o LEFT JOIN hits h ON {on("h", "o")} AND h.bar = o.bar AND h.context_scale = o.context_scale),
ended AS (SELECT *, CASE reason WHEN 'stop' THEN t_stop WHEN 'target' THEN t_target WHEN 'open' THEN n_bars - 1 END AS exit_bar FROM reasoned)
{_ended_sql("ended", per_side, gap_stop_at_open)}"""


def fates(bars: DataFrame, pivots: DataFrame, steps: DataFrame, which: str = ORDERS, per_side: float = 0.001, missed: float = 1.0, gap_stop_at_open: bool = False) -> DataFrame:
    """Every order as if it were alone: missed, expired or filled, and the trade of a filled one.

    The fill's bar counts for the exit too; a trade without exit ends at the last close as "open". A fill at the
    stop's price makes no trade. With gap_stop_at_open a stop that a bar opens beyond is left at that open instead of at
    the stop's price. steps: the ladder of bars, by which a trade's exit is found however far ahead it lies.
    """
    filled = query(_filled_sql(which, missed), bars=bars, pivots=pivots)
    low, high = (F.when(F.col("direction") * sign > 0, F.col("stop")).otherwise(F.col("target")) for sign in (1, -1))
    start = F.when(F.col("fill") != F.col("stop"), F.col("fill_bar"))
    found = hits.first_hits(filled.withColumns({"start": start, "lower": low, "upper": high}), steps)
    # within a bar the stop counts before the target
    template = f"""
WITH ended AS (
  SELECT o.*, coalesce(o.hit, o.n_bars - 1) AS exit_bar, CASE WHEN o.start IS NULL THEN NULL WHEN o.hit IS NULL THEN 'open' WHEN o.direction > 0 AND b.low <= o.stop OR o.direction < 0 AND b.high >= o.stop THEN 'stop' ELSE 'target' END AS reason
  FROM {{found}} o LEFT JOIN {{bars}} b ON {on("b", "o")} AND b.bar_idx = o.hit)
{_ended_sql("ended", per_side, gap_stop_at_open)}"""
    return query(template, found=found, bars=bars)


#: How long an order can wait at most where no bar comes, in seconds.
DEADLINE = 366 * 86_400
#: Orders as they are placed on a stream: an identifier, the price at which they are missed, and their last second.
PLACED = f"""
SELECT o.source, o.symbol, o.timeframe, o.bar, o.context_scale, o.direction, concat_ws('|', o.source, o.symbol, o.timeframe, cast(o.context_scale as string), cast(o.bar as string), cast(o.i1 as string)) AS id,
       o.p1 + o.direction * abs(o.p1 - o.p0) AS dead, o.limit_price, o.expiry_bar, b.ts_sec, b.ts_sec + {DEADLINE} AS deadline_sec
FROM ({ORDERS}) o JOIN {{bars}} b ON {on("b", "o")} AND b.bar_idx = o.bar"""


def in_turn(fates: DataFrame) -> DataFrame:
    """Orders that are placed while the last trade still runs are skipped."""
    gone = {"status": F.lit("skipped"), **{c: F.lit(None) for c in ("entry_bar", "exit_bar", "entry", "exit", "reason", "r")}}
    kept = {c: F.when(F.col("taken"), F.col(c)).otherwise(other) for c, other in gone.items()}
    return with_turns(fates, "bar", "exit_bar").withColumns(kept).select(*fates.columns)


def in_turn_sql(fates: str) -> str:
    """The same as a fold over lists, for DuckDB."""
    gone = ", ".join(f"CASE WHEN g.k IS NOT NULL THEN t.{c} END AS {c}" for c in ("entry_bar", "exit_bar", "entry", "exit", "reason", "r"))
    return f"""
SELECT t.source, t.symbol, t.timeframe, t.bar, t.context_scale, t.trigger_scale, t.direction, CASE WHEN g.k IS NOT NULL THEN t.status ELSE 'skipped' END AS status, t.stop, t.n_supporting, t.extended, {gone}
FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY bar, context_scale) AS k FROM ({fates}) c) t
LEFT JOIN (SELECT {KEY}, unnest(list_reduce(list({{'k': k, 'bar': bar, 'last': exit_bar}} ORDER BY k), lambda acc, x: CASE WHEN x.bar > acc.busy THEN {{'busy': coalesce(x.last, acc.busy), 'kept': list_append(acc.kept, x.k)}} ELSE acc END, {{'busy': -1, 'kept': []::BIGINT[]}}).kept) AS k
  FROM (SELECT {KEY}, row_number() OVER (PARTITION BY {KEY} ORDER BY bar, context_scale) AS k, bar, exit_bar FROM ({fates}) c) l GROUP BY {KEY}) g
ON t.source = g.source AND t.symbol = g.symbol AND t.timeframe = g.timeframe AND t.k = g.k"""


FATE_COUNTS = "SELECT status, count(*) AS n FROM {fates} GROUP BY status"
BY_CONFLUENCE = "SELECT n_supporting, count(*) AS n, round(avg(r), 6) AS mean_r FROM {fates} WHERE reason IS NOT NULL GROUP BY n_supporting"
BY_EXTENSION = "SELECT extended, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate FROM {fates} WHERE reason IS NOT NULL GROUP BY extended"


def orders(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    return query(ORDERS, bars=bars, pivots=pivots)


def sub_orders(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    return query(SUB_ORDERS, bars=bars, pivots=pivots)


def backtest(bars: DataFrame, pivots: DataFrame, steps: DataFrame | None = None, which: str = ORDERS, gap_stop_at_open: bool = False) -> DataFrame:
    """The fates of orders when a series holds one position at a time."""
    return in_turn(fates(bars, pivots, hits.ladder(bars) if steps is None else steps, which, gap_stop_at_open=gap_stop_at_open))


def placebo_sql(draws: int = 10, seed: int = 7) -> str:
    """Orders moved to scattered bars, each draw by itself, all their prices in proportion to the close there."""
    numbers = ", ".join(f"({i})" for i in range(draws))
    place = scattered(f"cast(o.bar as bigint) * 7919 + o.context_scale * 104729 + d.draw * 15485863 + {seed * 32452843}")
    at = f"{place} % greatest(n.n_bars - 62, 1)"
    return f"""
SELECT p.source, p.symbol, p.timeframe, cast(p.new_bar as int) AS bar, p.direction, cast(p.draw * 100 + p.context_scale as bigint) * 4294967296 + p.bar AS context_scale, p.p0 * k AS p0, p.p1 * k AS p1, p.limit_price * k AS limit_price, p.stop * k AS stop, p.target * k AS target,
       p.extended, cast(p.new_bar + p.expiry_bar - p.bar as int) AS expiry_bar, p.n_supporting
FROM (SELECT q.*, e.close / b.close AS k FROM (SELECT o.*, d.draw, {at} AS new_bar FROM ({ORDERS}) o CROSS JOIN (VALUES {numbers}) AS d(draw) JOIN (SELECT {KEY}, count(*) AS n_bars FROM {{bars}} GROUP BY {KEY}) n ON {on("n", "o")}) q
      JOIN {{bars}} b ON {on("b", "q")} AND b.bar_idx = q.bar JOIN {{bars}} e ON {on("e", "q")} AND e.bar_idx = q.new_bar) p"""


#: Real orders' {fates} against moved ones' {moved}, by direction: the control mean weighs directions as the real trades have them.
PLACEBO = "SELECT direction, count(*) AS n, round(avg(r), 5) AS mean_r FROM {moved} f WHERE reason IS NOT NULL GROUP BY direction"
CONTROL = f"""
SELECT sum(a.n) AS n, round(sum(a.n * a.mean_r) / sum(a.n), 5) AS real_r, round(sum(a.n * b.mean_r) / sum(a.n), 5) AS control_r
FROM (SELECT direction, count(*) AS n, avg(r) AS mean_r FROM {{fates}} f WHERE reason IS NOT NULL GROUP BY direction) a JOIN ({PLACEBO}) b ON a.direction = b.direction"""
