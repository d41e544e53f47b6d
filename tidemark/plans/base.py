"""The frames that queries read, for Spark (kept per session and folder) and as CTEs for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions import indicators
from tidemark.operators import hits, lattice
from tidemark.plans import duck
from tidemark.plans.frames import with_view
from tidemark.sources import bars
from tidemark.streaming.replay import shared_dir

_kept: dict[tuple, DataFrame] = {}
_folders: dict[str, str] = {}


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.resample(bars.walk_i(spark, sf_dir), "1h")


_BARS = {"walk_d": bars.walk_d, "walk_i": bars.walk_i, "walk_h": _hours}


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A frame that several queries read is computed once a session and written to the shared folder.

    So later plans begin with a scan (a cached frame would carry its whole plan into every plan that reads it), and no
    lost executor makes it be computed anew. It ends with forget().
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = with_view(stored(make()))
    return _kept[key]


def stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = f"{frames_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def frames_dir(spark: SparkSession) -> str:
    """Where this application's frames are; a local session without spark.checkpoint.dir has a folder of its own."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/tidemark-frames/{app}"
    return _folders[app]


def forget(spark: SparkSession) -> None:
    """Deletes the frames that this application has written; results that still read them end with them."""
    app = spark.sparkContext.applicationId
    at = spark._jvm.org.apache.hadoop.fs.Path(frames_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    for key in [k for k in _kept if k[0] == app]:
        del _kept[key]


def frame(spark: SparkSession, sf_dir: str, name: str, view: str) -> DataFrame:
    own = lambda: kept(spark, sf_dir, view, lambda: _BARS[view](spark, sf_dir))
    if name == "bars":
        return own()
    if name == "pivots":
        return kept(spark, sf_dir, f"pivots {view}", lambda: lattice.build(own()))
    if name == "ind":
        return kept(spark, sf_dir, f"ind {view}", lambda: indicators.smoothed(own()))
    if name == "steps":
        return kept(spark, sf_dir, f"steps {view}", lambda: hits.ladder(own()))
    raise KeyError(name)


HOURS_SQL = """
walk_h AS (SELECT source, symbol, '1h' AS timeframe, (row_number() OVER (PARTITION BY source, symbol ORDER BY bin) - 1)::INTEGER AS bar_idx, bin AS ts_sec, open, high, low, close, volume FROM (
  SELECT source, symbol, ts_sec // 3600 * 3600 AS bin, arg_min(open, ts_sec) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_sec) AS close, sum(volume) AS volume FROM walk_i GROUP BY source, symbol, bin))"""
VIEWS_SQL = {"walk_d": bars.WALK_D_SQL, "walk_i": bars.WALK_I_SQL, "walk_h": bars.WALK_I_SQL + "," + HOURS_SQL}


def with_sql(view: str, frames: tuple[str, ...]) -> str:
    """The CTEs of a view and of the frames on it: pivots, ind."""
    ctes = [VIEWS_SQL[view]]
    if "pivots" in frames:
        ctes.append(duck.pivots(view))
    if "ind" in frames:
        ctes.append(duck.indicators(view))
    return "WITH " + ",".join(ctes)
