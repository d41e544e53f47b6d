"""The ingest job: fetch what is wanted, derive what a service doesn't give, check it, store what is sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import integrity
from tidemark.sources import bars, catalog, rest

#: Timeframes that a service lacks, with the one that they are made from.
DERIVED = {("yfinance", "4h"): "1h"}


def fetch(spark: SparkSession, source: str, symbols: list[str], timeframe: str, start: int, end: int, **options: str) -> DataFrame:
    """Clean bars of one timeframe; a derived one ends with its last complete bar."""
    rest.register(spark)
    finer = DERIVED.get((source, timeframe), timeframe)
    raw = spark.read.format("rest_bars").options(source=source, symbols=",".join(symbols), timeframe=finer, start=start, end=end, **options).load()
    clean = bars.normalized(raw.withColumn("ingest_seq", F.monotonically_increasing_id()))
    return clean if finer == timeframe else bars.resample(clean, timeframe, as_of=end)


def ingest(fetched: DataFrame, root: str, fetched_at: int) -> DataFrame:
    """Stores the bars of sound series, records all in the stored manifest, and reports on them: bars, range, errors, warnings, ok, fetched_at, cluster."""
    kept = fetched.persist()
    verdict = integrity.verdict(kept.withColumn("ingest_seq", F.col("bar_idx")))
    keys = bars.SERIES
    clusters = kept.sparkSession.createDataFrame(catalog.UNIVERSE, "symbol string, source string, cluster string").drop("source")
    report = catalog.manifest(kept).join(verdict, keys, "left").fillna({"errors": 0, "warnings": 0, "ok": True}).join(clusters, "symbol", "left").withColumn("fetched_at", F.lit(fetched_at))
    sound = report.filter("ok").select(*keys)
    catalog.save(kept.join(sound, keys, "left_semi"), root)
    catalog.record(report, root)
    kept.unpersist()
    return catalog.recorded(kept.sparkSession, root).filter(F.col("fetched_at") == fetched_at)


def available(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("source", "symbol", "timeframe")
