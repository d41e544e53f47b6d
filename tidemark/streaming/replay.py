"""Tables run through streams in batches, for tests and small replays; each batch resumes from the checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session may leave it unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State with maps, lists and timers needs this store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def replayed(rows: DataFrame, run: Callable[[DataFrame], DataFrame], order: str, cuts: list[int]) -> DataFrame:
    """What `run` makes of rows that come in batches: those below the first cut of the column `order`, below the second, and so on, then the rest.

    A batch is appended to the source's folder by as many tasks as the rows have, and the query, started again from its
    checkpoint, takes what is new.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    bounds = [None, *sorted(set(cuts)), None]
    with rocksdb(spark):
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            inside = F.lit(True) if lo is None else F.col(order) >= lo
            rows.filter(inside if hi is None else inside & (F.col(order) < hi)).write.mode("append").parquet(f"{path}/in")
            out = run(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
            schema = out.schema
            out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/out")


def even_cuts(rows: DataFrame, order: str, batches: int) -> list[int]:
    most = rows.agg(F.max(order)).first()[0] or 0
    return [k * (most + 1) // batches for k in range(1, batches)]
