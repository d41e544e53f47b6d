"""Turning points from a stream of bars: the batch kernel's state kept for each series."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import kernel
from tidemark.sources.bars import SERIES
from tidemark.streaming import replay

OUT = "source string, symbol string, timeframe string, scale int, idx int, price double, kind int, confirmed_idx int, is_anchor boolean"
_STATE = "lattice binary, fed int"


def _feed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    lattice, fed = (pickle.loads(state.get[0]), state.get[1]) if state.exists else (kernel.Lattice(), 0)
    bars = pd.concat(list(batches)).sort_values("bar_idx")
    out = []
    for b in bars.itertuples():
        if b.bar_idx == fed:  # a bar that came before is a repeat; a gap would be an error of the source
            out += lattice.feed(float(b.high), float(b.low), float(b.close), kernel.WARMUP)
            fed += 1
    state.update((pickle.dumps(lattice), fed))
    rows = pd.DataFrame(out, columns=["scale", "idx", "price", "kind", "confirmed_idx", "is_anchor"])
    for name, value in zip(SERIES, key, strict=True):
        rows[name] = value
    yield rows[[*SERIES, "scale", "idx", "price", "kind", "confirmed_idx", "is_anchor"]]


def turning_points(bars: DataFrame) -> DataFrame:
    """Points as they become known; bars of a series come in the order of bar_idx over batches.

    A series of at least 16 bars gives what the batch operator gives for it.
    """
    return bars.select(*SERIES, "bar_idx", "high", "low", "close").groupBy(*SERIES).applyInPandasWithState(_feed, OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def closed_bars(ticks: DataFrame, timeframe: str, late: str = "1 hour") -> DataFrame:
    """Bars from a stream of (source, symbol, ts, ingest_seq, price, volume): only those that the watermark has closed."""
    from pyspark.sql import functions as F

    from tidemark.sources.bars import seconds

    w = F.window("ts", f"{seconds(timeframe)} seconds")
    made = ticks.withWatermark("ts", late).groupBy("source", "symbol", w.alias("w")).agg(
        F.min_by("price", F.struct("ts", "ingest_seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "ingest_seq")).alias("close"), F.sum("volume").alias("volume")
    )
    return made.select("source", "symbol", F.lit(timeframe).alias("timeframe"), F.unix_timestamp("w.start").alias("ts_sec"), "open", "high", "low", "close", "volume")


def replayed(bars: DataFrame, batches: int = 4) -> DataFrame:
    """A table of bars run through the stream in so many batches, and what came out."""
    return replay.replayed(bars, turning_points, "bar_idx", replay.even_cuts(bars, "bar_idx", batches))
