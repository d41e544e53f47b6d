"""Price bars: cleaning, indexing, resampling, and two series derived from transaction tables.

A bar's ts is when it opens; it is complete at ts + its timeframe. Every table of bars has
(source, symbol, timeframe, bar_idx, ts_sec, open, high, low, close, volume), ts_sec in epoch seconds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = ["source", "symbol", "timeframe"]
PRICES = ["open", "high", "low", "close"]
#: Seconds of each timeframe.
SECONDS = {"15m": 900, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
#: Weeks begin on Sunday; the first one after the epoch does so here.
WEEK_FROM = 259200


def seconds(timeframe: str) -> int:
    if timeframe not in SECONDS:
        raise ValueError(f"unknown timeframe {timeframe!r}; known: {', '.join(SECONDS)}")
    return SECONDS[timeframe]


def indexed(bars: DataFrame) -> DataFrame:
    """Adds bar_idx, the position in the series."""
    return bars.withColumn("bar_idx", (F.row_number().over(Window.partitionBy(*SERIES).orderBy("ts_sec")) - 1).cast("int"))


def _bucket(timeframe: str) -> Column:
    step, start = seconds(timeframe), WEEK_FROM if timeframe == "1w" else 0
    return F.floor((F.col("ts_sec") - start) / step) * step + start


def resample(bars: DataFrame, timeframe: str, as_of: int | None = None) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume; no bar for an empty bin.

    A symbol's bars must have one timeframe; bars of two in one bin are an error.
    as_of: epoch seconds; bars that aren't complete then are left out.
    """
    at = _bucket(timeframe).alias("bin")
    out = bars.groupBy("source", "symbol", at).agg(
        F.min_by("open", "ts_sec").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_sec").alias("close"), F.sum("volume").alias("volume"),
        F.min("timeframe").alias("finer"), F.max("timeframe").alias("finest"),
    )
    of_one = F.when(F.col("finer") != F.col("finest"), F.raise_error(F.concat(F.lit("bars of two timeframes: "), "symbol"))).otherwise(F.lit(timeframe))
    out = out.select("source", "symbol", of_one.alias("timeframe"), F.col("bin").cast("long").alias("ts_sec"), *PRICES, "volume")
    return indexed(out if as_of is None else complete(out, as_of))


def complete(bars: DataFrame, as_of: int) -> DataFrame:
    """Only the bars that are complete at as_of (epoch seconds). An unknown timeframe is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown timeframe "), F.coalesce("timeframe", F.lit("null")))).cast("int")
    step = F.coalesce(*(F.when(F.col("timeframe") == k, F.lit(v)) for k, v in SECONDS.items()), unknown)
    return bars.filter(F.col("ts_sec") + step <= as_of)


def normalized(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Raw bars made clean: column names, UTC seconds, doubles, the last arrival of each ts, no null prices.

    Names are lowered and blanks become underscores; adj_close stands in for a missing close. A later null
    row for a ts removes that ts (the last arrival counts, then nulls go); of arrivals that tie the higher prices count. NaN counts as null, a null
    volume as 0.
    """
    named = raw.toDF(*(c.strip().lower().replace(" ", "_") for c in raw.columns))
    if "close" not in named.columns and "adj_close" in named.columns:
        named = named.withColumnRenamed("adj_close", "close")
    if missing := [c for c in [*PRICES, "volume"] if c not in named.columns]:
        raise ValueError(f"columns are missing: {missing}")
    if "ts_sec" not in named.columns:
        named = named.withColumn("ts_sec", F.unix_timestamp("ts"))
    value = {c: F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c).cast("double")) for c in [*PRICES, "volume"]}
    latest = F.row_number().over(Window.partitionBy(*SERIES, "ts_sec").orderBy(F.col(order).desc(), *(F.col(c).desc() for c in [*PRICES, "volume"])))
    rows = named.withColumns(value).withColumn("n__", latest).filter("n__ = 1").dropna(subset=PRICES)
    return indexed(rows.select(*SERIES, "ts_sec", *PRICES, F.coalesce("volume", F.lit(0.0)).alias("volume")))


# ---- series from the driver's tables ----

#: Rows that a task puts in order, about: few enough to stay in its memory.
TASK_ROWS = 1 << 21
#: Tied places that are sent to every task (some MB); where there are more, they are joined by a shuffle.
SENT_PLACES = 100_000


def _dealt(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows exchanged by the columns, over as many tasks as their number asks for, however few the session's shuffles have."""
    spark, n = rows.sparkSession, rows.count()
    if n <= TASK_ROWS:
        return rows.repartition(*by)
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS)), *by)


def _tied(rows: DataFrame, place: WindowSpec) -> DataFrame:
    """Adds whether the steps of a row's place differ, so that the sums there depend on their order, and whether the place begins with it."""
    known, n = F.count("step").over(place), F.count("*").over(place)
    differ = F.coalesce(F.min("step").over(place) != F.max("step").over(place), F.lit(False)) | (known > 0) & (known < n)
    return rows.withColumns({"tied": differ, "begins": differ & (F.col("rn") == F.min("rn").over(place))})


def _untied(found: DataFrame, rows: DataFrame, made: Callable[[DataFrame], DataFrame], bar: list[str], order: list[str], ties: list[str]) -> DataFrame:
    """Prices and volume of each bar, with the sums in tied places as ties order them; the sum before a place doesn't depend on that.

    Places are sent to the rows by their number, not by what Spark takes for their size: it would else exchange all rows, with ties, for a few places.
    """
    from tidemark.plans.base import stored

    before = (F.coalesce("sum", F.lit(0)) - F.coalesce("step", F.lit(0))).alias("sum_before"), (F.col("rn") - 1).alias("rn_before")
    # a row for each bar (its last) and for each tied place (its first), which has two rows or more
    kept = stored(found.filter("rn = n or begins").select(*bar, "begins", "o", "h", "l", "c", "volume", *order, *before))
    prices = kept.filter("not begins").select(*bar, "o", "h", "l", "c", "volume")
    places = kept.filter("begins").select(*[F.col(c).alias(f"at_{c}") for c in [*bar, *order]], "sum_before", "rn_before")
    n = places.limit(SENT_PLACES + 1).count()
    if not n:
        return prices
    again = made(rows.join(F.broadcast(places) if n <= SENT_PLACES else places, [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in [*bar, *order]]))
    inside = Window.partitionBy(*bar, *order).orderBy(*ties)
    total, rn = F.col("sum_before") + F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("rn_before") + F.row_number().over(inside)
    sums = again.select(*bar, total.alias("sum"), rn.alias("rn")).select(*bar, F.when(F.col("rn") == 1, F.col("sum")), "sum", "sum", F.lit(None), F.lit(None))
    # written, since what follows reads it twice
    return stored(prices.union(sums).groupBy(*bar).agg(*[f(c).alias(c) for c, f in {"o": F.max, "h": F.max, "l": F.min, "c": F.max, "volume": F.max}.items()]))


def _walk(rows: DataFrame, value: str, step: Column, volume: Column, source: str, timeframe: str, order: list[str], ties: list[str]) -> DataFrame:
    """Bars of an integer random walk; rows: symbol, ts_sec (of the bar), order, ties (what orders rows after that) and the value that step and volume are made of.

    Running sums are taken within a bar and over bars, so no window holds a whole series' rows. Rows are exchanged without ties, so many to a task that
    their order needs no spill, and step and volume are made behind the exchange; where rows of one place in order have different steps, those alone are read again, with ties.
    """
    bar = ["symbol", "ts_sec"]
    made = lambda df: df.withColumns({"step": step, "volume": volume})
    inside, whole = Window.partitionBy(*bar).orderBy(*order), Window.partitionBy(*bar)
    found = made(_dealt(rows.select(*bar, value, *order), bar))
    found = found.withColumns({"sum": F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(inside)})
    if ties:
        found = _tied(found, Window.partitionBy(*bar, *order))
    free = F.when(~F.col("tied"), F.col("sum")) if ties else F.col("sum")
    prices = {"o": F.max(F.when(F.col("rn") == 1, free)), "h": F.max(free), "l": F.min(free), "c": F.sum("step"), "volume": F.sum("volume"), "n": F.max("rn")}
    found = found.withColumns({c: x.over(whole) for c, x in prices.items()})
    per_bar = _untied(found, rows, made, bar, order, ties) if ties else found.filter("rn = n").select(*bar, "o", "h", "l", "c", "volume")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("symbol").orderBy("ts_sec").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = per_bar.withColumn("before", before)
    base = placed.agg((2 * F.max(F.greatest(F.abs(F.col("before") + F.col("h")), F.abs(F.col("before") + F.col("l"))))).alias("base"))
    price = lambda c: (F.col("base") + F.col("before") + F.col(c)).cast("double")
    return indexed(
        placed.crossJoin(F.broadcast(base)).select(
            F.lit(source).alias("source"), "symbol", F.lit(timeframe).alias("timeframe"), "ts_sec", price("o").alias("open"), price("h").alias("high"), price("l").alias("low"), price("c").alias("close"), F.col("volume").cast("double").alias("volume")
        )
    )


def walk_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of six series from lineitem, by return flag and line status."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order, ties = ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    rows = items.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400) * 86400).alias("ts_sec"), *order, *ties
    )
    return _walk(rows, "l_quantity", (2 * F.col("l_quantity") - 51).cast("long"), F.col("l_quantity"), "lineitem", "1d", order, ties)


def walk_i(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hourly bars of five series from events, by type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    order, cents = ["ts", "event_id"], F.round(F.col("value") * 100).cast("long")
    rows = events.select(
        F.col("event_type").alias("symbol"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 900) * 900).alias("ts_sec"), F.when(F.col("event_id") % 2 == 0, cents).otherwise(-cents).alias("step"), *order
    )
    return _walk(rows, "step", F.col("step"), F.lit(1), "events", "15m", order, [])


def _walk_sql(steps: str, source: str, timeframe: str, order: str, name: str) -> str:
    return f"""
{name}_steps AS ({steps}),
{name}_rows AS (SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY ts_sec, {order} ROWS UNBOUNDED PRECEDING) AS cum,
                row_number() OVER (PARTITION BY symbol ORDER BY ts_sec, {order}) AS rn FROM {name}_steps),
{name}_base AS (SELECT 2 * max(abs(cum)) AS base FROM {name}_rows),
{name} AS (SELECT '{source}' AS source, symbol, '{timeframe}' AS timeframe, (row_number() OVER (PARTITION BY symbol ORDER BY ts_sec) - 1)::INTEGER AS bar_idx, ts_sec::BIGINT AS ts_sec,
           (base + arg_min(cum, rn))::DOUBLE AS open, (base + max(cum))::DOUBLE AS high, (base + min(cum))::DOUBLE AS low, (base + arg_max(cum, rn))::DOUBLE AS close, sum(volume)::DOUBLE AS volume
         FROM {name}_rows, {name}_base GROUP BY symbol, ts_sec, base)"""


#: DuckDB's CTEs for the two series.
WALK_D_SQL = _walk_sql(
    "SELECT l_returnflag || l_linestatus AS symbol, (floor(epoch(l_shipdate) / 86400) * 86400)::BIGINT AS ts_sec, (2 * l_quantity - 51)::BIGINT AS step, l_quantity AS volume, * FROM lineitem",
    "lineitem", "1d", "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice", "walk_d",
)
WALK_I_SQL = _walk_sql(
    "SELECT event_type AS symbol, (floor(epoch(ts) / 900) * 900)::BIGINT AS ts_sec, CASE WHEN event_id % 2 = 0 THEN round(value * 100)::BIGINT ELSE -round(value * 100)::BIGINT END AS step, 1 AS volume, ts, event_id FROM events",
    "events", "15m", "ts, event_id", "walk_i",
)
