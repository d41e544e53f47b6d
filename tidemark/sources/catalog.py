"""The catalogue: instruments, what is stored of them, what is fit for use; and the store itself."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.frames import KEY, query

#: Instruments as (symbol, source, cluster), and those held out for the last test.
UNIVERSE = (
    ("BTCUSDT", "binance", "crypto_major"), ("ETHUSDT", "binance", "crypto_major"), ("SOLUSDT", "binance", "crypto_alt"), ("LINKUSDT", "binance", "crypto_alt"), ("BNBUSDT", "binance", "crypto_alt"),
    ("ADAUSDT", "binance", "crypto_alt"), ("AVAXUSDT", "binance", "crypto_alt"), ("DOTUSDT", "binance", "crypto_alt"), ("XRPUSDT", "binance", "crypto_alt"), ("LTCUSDT", "binance", "crypto_alt"),
    ("GC=F", "yfinance", "metals"), ("SI=F", "yfinance", "metals"), ("HG=F", "yfinance", "metals"), ("CL=F", "yfinance", "energy"), ("NG=F", "yfinance", "energy"),
    ("^GSPC", "yfinance", "equity_index"), ("^NDX", "yfinance", "equity_index"), ("AAPL", "yfinance", "equity_tech"), ("MSFT", "yfinance", "equity_tech"), ("NVDA", "yfinance", "equity_tech"),
    ("AMZN", "yfinance", "equity_tech"), ("META", "yfinance", "equity_tech"), ("GOOGL", "yfinance", "equity_tech"), ("TSLA", "yfinance", "equity_tech"), ("JPM", "yfinance", "equity_fin"),
)
HOLDOUT = ("LTCUSDT", "DOTUSDT", "NG=F", "JPM", "GOOGL")

UNIVERSE_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in UNIVERSE) + ") AS u(symbol, source, cluster)"
HOLDOUT_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in HOLDOUT) + ") AS h(symbol)"
TRAINING = f"SELECT u.symbol, u.source, u.cluster, replace(replace(replace(u.symbol, '/', '_'), '^', 'idx_'), '=', '_') AS path_name FROM {UNIVERSE_SQL} LEFT ANTI JOIN {HOLDOUT_SQL} ON u.symbol = h.symbol"
TRAINING_SQL = f"SELECT u.symbol, u.source, u.cluster, replace(replace(replace(u.symbol, '/', '_'), '^', 'idx_'), '=', '_') AS path_name FROM {UNIVERSE_SQL} WHERE u.symbol NOT IN (SELECT symbol FROM {HOLDOUT_SQL})"

MANIFEST = f"SELECT {KEY}, count(*) AS n_bars, min(ts_sec) AS start_sec, max(ts_sec) AS end_sec FROM {{bars}} GROUP BY {KEY}"


def usable_sql(min_bars: int, holdout: tuple[str, ...] = HOLDOUT, timeframes: tuple[str, ...] = ()) -> str:
    """Series without errors, with enough bars, that aren't held out; of these timeframes only, if any are named."""
    from tidemark.operators.integrity import VERDICT

    out = ", ".join(f"'{x}'" for x in holdout) or "''"
    wanted = "AND m.timeframe IN (" + ", ".join(f"'{x}'" for x in timeframes) + ")" if timeframes else ""
    return f"""
SELECT m.source, m.symbol, m.timeframe, m.n_bars, m.start_sec, m.end_sec FROM ({MANIFEST}) m
LEFT JOIN ({VERDICT.replace("{raw}", "(SELECT *, bar_idx AS ingest_seq FROM {bars})")}) v ON v.source = m.source AND v.symbol = m.symbol AND v.timeframe = m.timeframe
WHERE m.n_bars >= {min_bars} AND coalesce(v.ok, true) AND m.symbol NOT IN ({out}) {wanted}"""


def manifest(bars: DataFrame) -> DataFrame:
    return query(MANIFEST, bars=bars)


def usable(bars: DataFrame, min_bars: int, holdout: tuple[str, ...] = HOLDOUT, timeframes: tuple[str, ...] = ()) -> DataFrame:
    return query(usable_sql(min_bars, holdout, timeframes), bars=bars)


def upsert(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest with entries put in; of several for one series the one fetched last stays."""
    every = manifest.unionByName(entries, allowMissingColumns=True)
    latest = every.groupBy("source", "symbol", "timeframe").agg(F.max_by(F.struct(*every.columns), "fetched_at").alias("e"))
    return latest.select("e.*")


_ENTRY = ["source", "symbol", "timeframe"]


def record(entries: DataFrame, root: str) -> None:
    """Puts entries (KEY, fetched_at and more) into the manifest stored beside the bars.

    The manifest is a log: each writer adds a folder of its own, published by its commit, so two at once lose no entry.
    """
    entries.withColumn("recorded_at", F.current_timestamp()).write.parquet(f"{root.rstrip('/')}_manifest/recorded_by={uuid.uuid4().hex}")


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """The stored manifest: of several entries for a series the one fetched last, then the one recorded last."""
    log = spark.read.option("mergeSchema", "true").parquet(f"{root.rstrip('/')}_manifest")
    latest = log.groupBy(*_ENTRY).agg(F.max_by(F.struct(*log.columns), F.struct("fetched_at", "recorded_at", "recorded_by")).alias("e"))
    return latest.select("e.*").drop("recorded_at", "recorded_by")


def as_json(manifest: DataFrame) -> DataFrame:
    """One row: the manifest as a JSON object, its keys source/symbol/timeframe in order. A row a series, so it fits."""
    entry = F.struct(F.concat_ws("/", *_ENTRY).alias("key"), F.struct(*manifest.columns).alias("value"))
    return manifest.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("manifest"))


def path_name(symbol: Column) -> Column:
    """A symbol as part of a path. "A/B" and "A=B" fall together."""
    return F.replace(F.replace(F.replace(symbol, F.lit("/"), F.lit("_")), F.lit("^"), F.lit("idx_")), F.lit("="), F.lit("_"))


#: Each bar as text; a digest of it is a number, and the series' digest the sum of its bars', in any order.
def _as_text(c: str) -> str:
    """A number to twelve decimals; a large one as its power of ten and what is left to twelve decimals."""
    power = f"floor(log10(abs({c})))"
    large = f"concat('e', cast(cast({power} as int) as varchar(9)), ':', cast(cast({c} / power(10e0, {power}) as decimal(38,12)) as varchar(60)))"
    return f"CASE WHEN {c} IS NULL THEN 'null' WHEN isnan({c}) THEN 'nan' WHEN abs({c}) < 1e25 THEN cast(cast({c} as decimal(38,12)) as varchar(60)) WHEN abs({c}) > 1.7e308 THEN 'inf' ELSE {large} END"


_BAR = "concat_ws('|', ts_sec, " + ", ".join(map(_as_text, ("open", "high", "low", "close", "volume"))) + ")"
CONTENT_HASH = f"""
SELECT source, symbol, timeframe, lpad(cast(cast(sum(digest) % 10000000000000000 as bigint) as string), 16, '0') AS hash
FROM (SELECT source, symbol, timeframe, cast(conv(substring(md5({_BAR}), 1, 15), 16, 10) as decimal(28,0)) AS digest FROM {{bars}}) b GROUP BY source, symbol, timeframe"""
#: The same in DuckDB's words.
CONTENT_HASH_SQL = CONTENT_HASH.replace("conv(substring(md5(", "('0x' || substring(md5(").replace("), 1, 15), 16, 10)", "), 1, 15))::BIGINT")


def content_hash(bars: DataFrame) -> DataFrame:
    """16 digits that change with any value of a series (to twelve decimals); sums of parts can be added."""
    return query(CONTENT_HASH, bars=bars)


def save(bars: DataFrame, root: str) -> None:
    """Writes bars into one folder for each series (Parquet, zstd); series that are there already are replaced."""
    named = bars.withColumn("path_symbol", path_name(F.col("symbol")))
    writer = named.repartition("source", "path_symbol", "timeframe").sortWithinPartitions("source", "path_symbol", "timeframe", "ts_sec").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("source", "path_symbol", "timeframe").parquet(root)


def load(spark: SparkSession, root: str, source: str, symbol: str, timeframe: str) -> DataFrame:
    """One series; only its folder is read. Raises FileNotFoundError where there is none."""
    found = spark.read.parquet(root).filter((F.col("source") == source) & (F.col("path_symbol") == path_name(F.lit(symbol))) & (F.col("timeframe") == timeframe))
    if not found.head(1):
        raise FileNotFoundError(f"{source}/{symbol}/{timeframe} in {root}")
    return found.drop("path_symbol")
