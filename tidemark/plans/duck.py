"""DuckDB's own way to smoothed ranges and turning points: folds over lists, independent of the kernel."""

from __future__ import annotations

from tidemark.operators.kernel import PERIOD, THETAS, WARMUP

_POINT = "STRUCT(idx INTEGER, price DOUBLE, kind INTEGER, known INTEGER, anchor BOOLEAN)"


def ewm(values: str, alpha: str) -> str:
    """A list smoothed exponentially from its first value."""
    return f"list_reduce({values}[2:], lambda acc, x: list_append(acc, acc[-1] * (1 - {alpha}) + x * {alpha}), [{values}[1]])"


def _fold(items: str, theta: float, seed: str) -> str:
    """items: structs of i, h, l, known in order; atr: a list beside them."""
    new = (
        "{'nh': acc.dir >= 0 AND x.h > acc.hi, 'nl': acc.dir <= 0 AND x.l < acc.lo,"
        " 'hi': CASE WHEN acc.dir >= 0 AND x.h > acc.hi THEN x.h ELSE acc.hi END, 'hi_i': CASE WHEN acc.dir >= 0 AND x.h > acc.hi THEN x.i ELSE acc.hi_i END,"
        " 'lo': CASE WHEN acc.dir <= 0 AND x.l < acc.lo THEN x.l ELSE acc.lo END, 'lo_i': CASE WHEN acc.dir <= 0 AND x.l < acc.lo THEN x.i ELSE acc.lo_i END}"
    )
    down = f"(acc.dir = 0 AND t.hi - x.l >= {theta} * atr[t.hi_i + 1] AND t.hi - x.l >= x.h - t.lo) OR (acc.dir = 1 AND NOT t.nh AND t.hi - x.l >= {theta} * atr[t.hi_i + 1])"
    up = f"(acc.dir = 0 AND x.h - t.lo >= {theta} * atr[t.lo_i + 1]) OR (acc.dir = -1 AND NOT t.nl AND x.h - t.lo >= {theta} * atr[t.lo_i + 1])"
    step = (
        "{'dir': CASE WHEN u.d THEN -1 WHEN u.u THEN 1 ELSE acc.dir END,"
        " 'hi': CASE WHEN NOT u.d AND u.u THEN x.h ELSE u.t.hi END, 'hi_i': CASE WHEN NOT u.d AND u.u THEN x.i ELSE u.t.hi_i END,"
        " 'lo': CASE WHEN u.d THEN x.l ELSE u.t.lo END, 'lo_i': CASE WHEN u.d THEN x.i ELSE u.t.lo_i END,"
        " 'out': CASE WHEN u.d THEN list_append(acc.out, {'idx': u.t.hi_i, 'price': u.t.hi, 'kind': 1, 'known': x.known, 'anchor': acc.dir = 0})"
        " WHEN u.u THEN list_append(acc.out, {'idx': u.t.lo_i, 'price': u.t.lo, 'kind': -1, 'known': x.known, 'anchor': acc.dir = 0}) ELSE acc.out END}"
    )
    body = f"list_transform(list_transform([{new}], lambda t: {{'t': t, 'd': {down}, 'u': {up}}}), lambda u: {step})[1]"
    start = f"{{'dir': 0, 'hi': {seed}.h, 'hi_i': {seed}.i, 'lo': {seed}.l, 'lo_i': {seed}.i, 'out': []::{_POINT}[]}}"
    return f"list_reduce({items}, lambda acc, x: {body}, {start}).out"


def pivots(bars: str, name: str = "pivots") -> str:
    """CTEs that end in `name`, from a CTE of bars."""
    n = name
    out = f"""
{n}_tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY source, symbol, timeframe ORDER BY bar_idx) AS pc FROM {bars})),
{n}_series AS (SELECT source, symbol, timeframe, count(*) AS n, list(tr ORDER BY bar_idx) AS trs, list({{'i': bar_idx, 'h': high, 'l': low, 'known': bar_idx}} ORDER BY bar_idx) AS items FROM {n}_tr GROUP BY source, symbol, timeframe),
{n}_atr AS (SELECT *, {ewm("trs", f"(1.0::DOUBLE / {PERIOD})")} AS atr, least({WARMUP}, greatest(n - 2, 0)) AS start FROM {n}_series),
{n}_0 AS (SELECT source, symbol, timeframe, atr, CASE WHEN n - start < 2 THEN []::{_POINT}[] ELSE {_fold("items[start + 2:]", THETAS[0], "items[start + 1]")} END AS points FROM {n}_atr),"""
    for k in range(1, len(THETAS)):
        out += f"""
{n}_i{k} AS (SELECT *, list_transform(points, lambda p: {{'i': p.idx, 'h': p.price, 'l': p.price, 'known': p.known}}) AS items FROM {n}_{k - 1}),
{n}_{k} AS (SELECT source, symbol, timeframe, atr, CASE WHEN len(items) < 2 THEN []::{_POINT}[] ELSE {_fold("items", THETAS[k], "items[1]")} END AS points FROM {n}_i{k}),"""
    union = " UNION ALL ".join(f"SELECT source, symbol, timeframe, {k} AS scale, points FROM {n}_{k}" for k in range(len(THETAS)))
    return (
        out
        + f"""
{n}_all AS ({union}),
{n} AS (SELECT source, symbol, timeframe, scale, (seq - 1)::INTEGER AS seq, p.idx AS idx, p.price AS price, p.kind AS kind, p.known AS confirmed_idx, p.anchor AS is_anchor
  FROM (SELECT source, symbol, timeframe, scale, generate_subscripts(points, 1) AS seq, unnest(points) AS p FROM {n}_all))"""
    )


def indicators(bars: str, name: str = "ind") -> str:
    """CTEs that end in `name`: bars with atr, rsi, macd, macd_signal, macd_hist."""
    n, w = name, "PARTITION BY source, symbol, timeframe ORDER BY bar_idx"
    third = "2.0::DOUBLE / "
    return f"""
{n}_tr AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, close - pc AS move FROM (SELECT *, lag(close) OVER ({w}) AS pc FROM {bars})),
{n}_l AS (SELECT source, symbol, timeframe, list(bar_idx ORDER BY bar_idx) AS idxs, list(tr ORDER BY bar_idx) AS trs, list(close ORDER BY bar_idx) AS closes,
          list(greatest(move, 0.0) ORDER BY bar_idx) FILTER (WHERE move IS NOT NULL) AS gains, list(greatest(-move, 0.0) ORDER BY bar_idx) FILTER (WHERE move IS NOT NULL) AS losses FROM {n}_tr GROUP BY source, symbol, timeframe),
{n}_e AS (SELECT *, {ewm("trs", "(1.0::DOUBLE / 14)")} AS atrs, CASE WHEN len(gains) > 0 THEN {ewm("gains", "(1.0::DOUBLE / 14)")} END AS g, CASE WHEN len(losses) > 0 THEN {ewm("losses", "(1.0::DOUBLE / 14)")} END AS lo,
          {ewm("closes", f"({third}13)")} AS fast, {ewm("closes", f"({third}27)")} AS slow FROM {n}_l),
{n}_m AS (SELECT *, list_transform(fast, lambda x, i: x - slow[i]) AS line FROM {n}_e),
{n}_s AS (SELECT *, {ewm("line", f"({third}10)")} AS signal FROM {n}_m),
{n}_u AS (SELECT source, symbol, timeframe, unnest(idxs) AS bar_idx, unnest(atrs) AS atr, unnest(line) AS macd, unnest(signal) AS macd_signal,
          unnest(list_prepend(NULL, g)) AS g, unnest(list_prepend(NULL, lo)) AS lo FROM {n}_s),
{n} AS (SELECT b.*, u.atr, CASE WHEN u.lo IS NULL OR u.lo = 0 THEN 50.0 ELSE 100 - 100 / (1 + u.g / u.lo) END AS rsi, u.macd, u.macd_signal, u.macd - u.macd_signal AS macd_hist
  FROM {bars} b JOIN {n}_u u ON b.source = u.source AND b.symbol = u.symbol AND b.timeframe = u.timeframe AND b.bar_idx = u.bar_idx)"""
