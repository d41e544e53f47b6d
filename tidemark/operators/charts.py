"""What a chart of a series needs: the last bars, and the turning points among them, by scale."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.plans.frames import KEY, on, query


def chart_sql(last: int) -> str:
    """Points of each scale within the last bars, with how many there are and their median lag."""
    return f"""
SELECT p.source, p.symbol, p.timeframe, p.scale, p.idx, p.price, p.kind, p.confirmed_idx, count(*) OVER (PARTITION BY p.source, p.symbol, p.timeframe, p.scale) AS n_points, t.n_bars
FROM {{pivots}} p JOIN (SELECT {KEY}, max(bar_idx) AS last_bar, least(count(*), {int(last)}) AS n_bars FROM {{bars}} GROUP BY {KEY}) t ON {on("t", "p")} AND p.idx > t.last_bar - {int(last)}"""


def chart(bars: DataFrame, pivots: DataFrame, last: int = 400) -> DataFrame:
    return query(chart_sql(last), bars=bars, pivots=pivots)
