"""Operators are SQL over named frames; a frame is a DataFrame for Spark, a CTE's name for other engines."""

from __future__ import annotations

import re
from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame

KEY = "source, symbol, timeframe"
BY_BAR = f"PARTITION BY {KEY} ORDER BY bar_idx"


def on(a: str, b: str) -> str:
    """The two aliases belong to one series."""
    return f"{a}.source = {b}.source AND {a}.symbol = {b}.symbol AND {a}.timeframe = {b}.timeframe"


#: A prime below 2^31: products of two remainders fit a bigint, and fifth powers permute them.
PRIME = 2_147_483_647


def scattered(number: str) -> str:
    """A number from 0 to PRIME - 1 that looks random, the same in every engine; number: a bigint, not negative.

    Not affine, so numbers that differ by a constant don't give places that do.
    """
    rest = f"(({number}) % {PRIME})"
    square = f"({rest} * {rest} % {PRIME})"
    return f"({square} * {square} % {PRIME} * {rest} % {PRIME})"


#: Bars of a series in a block, as a power of two.
BLOCK_BITS = 8
_SPREAD = re.compile(r"<<spread (.+?) ;; (.+?) ;; (.+?)>>", re.S)
_IN_BLOCK = re.compile(r"<<(\w+) in block of (\w+)>>")


def spread(table: str, first: str, last: str) -> str:
    """A table in whose place Spark reads its rows once for each block of bars that first..last meets.

    With in_block in the condition, a range of bars is joined by series and block: no task holds more
    than a block's bars against the rows that meet it. A row without bounds stays once.
    """
    return f"<<spread {table} ;; {first} ;; {last}>>"


def in_block(bars: str, rows: str) -> str:
    """A bar lies in a spread row's block; the range itself must be a condition beside it."""
    return f"<<{bars} in block of {rows}>>"


#: Texts that Spark and DuckDB have in different forms, by the number of their marker.
_forms: list[tuple[str, str]] = []
_FORM = re.compile(r"<<form (\d+)>>")


def form(spark: str, plain: str) -> str:
    """A marker in whose place Spark reads the first text, and DuckDB the second (over CTEs named as the frames)."""
    _forms.append((spark, plain.replace("{pivots}", "pivots")))
    return f"<<form {len(_forms) - 1}>>"


def _formed(template: str, which: int) -> str:
    while _FORM.search(template):
        template = _FORM.sub(lambda m: _forms[int(m[1])][which], template)
    return template


#: Bars in a block of the as-of joins, as a power of two.
AS_OF_BITS = 12


def as_of(rows: str, bar: str, scale: str, facts: str, at: str, keep: dict[str, str], *, strict: bool = False, left: bool = False) -> str:
    """rows with columns of the last fact of their series and scale that is known at a bar.

    bar, scale: expressions of rows' columns. facts: KEY, scale, seq and more; `at` doesn't fall with seq. keep: new name of each
    column taken. strict: facts before the bar alone. left: rows without a fact stay, with nulls.

    Spark puts facts and rows of a block of bars in order together and carries the last fact forward; a block begins with
    the last fact of the blocks before it. So the join has no condition but equal ones, and a series no task of its own.
    """
    block = lambda x: f"shiftright(cast({x} as int), <<bits>>)"
    fact, before = f"struct({', '.join(keep)})", f"{int(strict)} AS side"
    by = "as_source, as_symbol, as_timeframe"
    named = "source AS as_source, symbol AS as_symbol, timeframe AS as_timeframe"
    lasts = f"SELECT {named}, scale AS as_scale, {block(at)} AS as_block, max_by({fact}, seq) AS fact FROM ({facts}) f GROUP BY source, symbol, timeframe, scale, {block(at)}"
    upto = f"SELECT *, coalesce(lead(as_block) OVER (PARTITION BY {by}, as_scale ORDER BY as_block), max(as_block) OVER (PARTITION BY {by})) AS upto FROM ({lasts}) l"
    spark = f"""(
SELECT probe.*, {", ".join(f"fact.{c} AS {name}" for c, name in keep.items())} FROM (
  SELECT probe, last_value(fact, true) OVER (PARTITION BY {by}, as_scale, as_block ORDER BY as_at, side, as_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fact FROM (
    SELECT {named}, scale AS as_scale, {block(at)} AS as_block, cast({at} as int) AS as_at, {before}, cast(seq as int) AS as_seq, {fact} AS fact, NULL AS probe FROM ({facts}) f
    UNION ALL
    SELECT {by}, as_scale, explode(sequence(as_block + 1, upto)), -1, 0, -1, fact, NULL FROM ({upto}) u WHERE upto > as_block
    UNION ALL
    SELECT x.source, x.symbol, x.timeframe, {scale}, least({block(bar)}, e.last_block), cast({bar} as int), {int(not strict)}, -1, NULL, struct(x.*)
    FROM {rows} x LEFT JOIN (SELECT {KEY}, max({block(at)}) AS last_block FROM ({facts}) f GROUP BY {KEY}) e ON {on("e", "x")}) m) w
WHERE probe IS NOT NULL{"" if left else " AND fact IS NOT NULL"})"""
    more, less = (">", "<=") if strict else (">=", "<")
    plain = f"""(
SELECT x.*, {", ".join(f"f.{c} AS {name}" for c, name in keep.items())}
FROM {rows} x {"LEFT " if left else ""}JOIN (SELECT *, lead({at}) OVER (PARTITION BY {KEY}, scale ORDER BY seq) AS as_upto FROM ({facts}) g) f
ON {on("f", "x")} AND f.scale = {scale} AND {bar} {more} f.{at} AND (f.as_upto IS NULL OR {bar} {less} f.as_upto))"""
    return form(spark, plain)


def inside(rows: str, scale: str, first: str, last: str, known: str, name: str) -> str:
    """rows with the number of turning points of a scale that lie between two bars, both excluded, and are known at a third.

    Spark takes the difference of places in the scale, found by as-of joins, since points are in order of their bar and of the bar at
    which they are known; DuckDB counts.
    """
    points = "SELECT * FROM {pivots}"
    a = as_of(rows, first, scale, points, "idx", {"seq": f"{name}_a"}, left=True)
    b = as_of(a, last, scale, points, "idx", {"seq": f"{name}_b"}, strict=True, left=True)
    c = as_of(b, known, scale, points, "confirmed_idx", {"seq": f"{name}_c"}, left=True)
    spark = f"(SELECT *, greatest(0, least(coalesce({name}_b, -1), coalesce({name}_c, -1)) - coalesce({name}_a, -1)) AS {name} FROM {c} x)"
    plain = f"""(
SELECT x.*, (SELECT count(*) FROM {{pivots}} p WHERE {on("p", "x")} AND p.scale = {scale} AND p.idx > {first} AND p.idx < {last} AND p.confirmed_idx <= {known}) AS {name}
FROM {rows} x)"""
    return form(spark, plain)


def blocked(template: str) -> str:
    """As Spark runs it."""
    block = lambda x: f"shiftright(cast({x} as int), {BLOCK_BITS})"
    out = _SPREAD.sub(lambda m: f"(SELECT *, explode_outer(CASE WHEN {m[2]} <= {m[3]} THEN sequence({block(m[2])}, {block(m[3])}) END) AS in_block FROM {m[1]})", _formed(template, 0).replace("<<bits>>", str(AS_OF_BITS)))
    return _IN_BLOCK.sub(lambda m: f"AND {block(m[1] + '.bar_idx')} = {m[2]}.in_block", out)


def plain(template: str) -> str:
    """The same without blocks, a join by range alone, for checking."""
    return _IN_BLOCK.sub("", _SPREAD.sub(lambda m: m[1], _formed(template, 1)))


#: The views of frames that are kept.
_views: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def with_view(df: DataFrame) -> DataFrame:
    """df, which queries read from now on by a view that stays: a view that is dropped takes its frame's cache with it."""
    if df not in _views:
        name = f"tidemark_{uuid4().hex}"
        df.createOrReplaceGlobalTempView(name)
        _views[df] = f"global_temp.{name}"
    return df


def query(template: str, **frames: DataFrame) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    # other frames are named by Spark for the time of the call
    named = blocked(template).format(**{name: _views.get(df, "{" + name + "}") for name, df in frames.items()})
    return spark.sql(named, **{name: df for name, df in frames.items() if df not in _views})
