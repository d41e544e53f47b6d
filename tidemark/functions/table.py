"""Turning points as a table function for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from tidemark.operators import kernel


@udtf(returnType="scale int, seq int, idx int, price double, kind int, confirmed_idx int, is_anchor boolean")
class TurningPoints:
    """TABLE(...) PARTITION BY the series ORDER BY bar_idx, with high, low and close."""

    def __init__(self):
        self.high, self.low, self.close = [], [], []

    def eval(self, row: Row) -> None:
        self.high.append(row["high"])
        self.low.append(row["low"])
        self.close.append(row["close"])

    def terminate(self) -> Iterator[tuple]:
        seen: dict[int, int] = {}
        for scale, *point in kernel.turning_points(self.high, self.low, self.close):
            seq = seen[scale] = seen.get(scale, -1) + 1
            yield (scale, seq, *point)


def register(spark: SparkSession) -> None:
    spark.udtf.register("turning_points", TurningPoints)
