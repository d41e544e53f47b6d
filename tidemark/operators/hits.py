"""The first bar that reaches one of two prices, however far ahead it lies, and what was known as of a bar.

Extremes of blocks of bars (lowest low and highest high) stand in a ladder of levels: bars, and blocks of 2^8, 2^12,
2^16 and 2^20 of them. A search looks at most at the rest of its own block on each level, which are at most 256 rows
each, takes the lowest level that holds a hit, and goes down from there, again through one block a level. All joins are
on the series and a block, so what a search reads doesn't grow with how far ahead its hit lies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bars import SERIES

#: Powers of two of bars in a block, by level; the last level's blocks are all one group.
BITS = (0, 8, 12, 16, 20)


def ladder(bars: DataFrame) -> DataFrame:
    """SERIES, level, parent (the block of the next level), place (the bar or block), lo, hi."""
    rows = bars.select(*SERIES, F.col("bar_idx").cast("long").alias("place"), F.col("low").alias("lo"), F.col("high").alias("hi"))
    out = []
    for level, bits in enumerate(BITS):
        up = BITS[level + 1] - bits if level + 1 < len(BITS) else 63
        out.append(rows.select(*SERIES, F.lit(level).alias("level"), F.shiftright("place", up).alias("parent"), "place", "lo", "hi"))
        rows = rows.groupBy(*SERIES, F.shiftright("place", up).alias("place")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return reduce(DataFrame.unionByName, out)


def first_hits(rows: DataFrame, steps: DataFrame) -> DataFrame:
    """rows with `hit`: the first bar from `start` on with a low of at most `lower` or a high of at least `upper`, if there is one.

    rows: SERIES, start, lower, upper and more, distinct; without start there is no hit. steps: a ladder.
    """
    s = steps.select(*[F.col(c).alias(f"s_{c}") for c in steps.columns])
    same = [F.col(c) == F.col(f"s_{c}") for c in SERIES]
    reached = (F.col("s_lo") <= F.col("lower")) | (F.col("s_hi") >= F.col("upper"))
    # on each level the rest of the block of the next level that holds the start
    start = F.col("start").cast("long")
    places = [F.struct(F.lit(k).alias("level"), F.shiftright(start, BITS[k + 1] if k + 1 < len(BITS) else 63).alias("parent"), (F.shiftright(start, bits) - (1 if k == 0 else 0)).alias("after")) for k, bits in enumerate(BITS)]
    probes = rows.select(F.struct(*rows.columns).alias("row"), *SERIES, "lower", "upper", F.explode(F.array(*places)).alias("p")).select("*", "p.*")
    met = probes.join(s, [*same, F.col("level") == F.col("s_level"), F.col("parent") == F.col("s_parent"), F.col("s_place") > F.col("after"), reached], "left")
    # what lies on a lower level lies before
    at = met.groupBy("row").agg(F.min(F.when(F.col("s_place").isNotNull(), F.struct(F.col("s_level").alias("level"), F.col("s_place").alias("place")))).alias("at"))
    for level in range(len(BITS) - 1, 0, -1):
        open_ = at.select("row", "at", *[F.col(f"row.{c}").alias(c) for c in (*SERIES, "lower", "upper")], F.when(F.col("at.level") == level, F.lit(level - 1)).alias("below"))
        down = open_.join(s, [*same, F.col("below") == F.col("s_level"), F.col("at.place") == F.col("s_parent"), reached], "left")
        found = F.min(F.struct(F.coalesce("below", "at.level").alias("level"), F.coalesce("s_place", "at.place").alias("place")))
        at = down.groupBy("row").agg(found.alias("at"))
    return at.select("row.*", F.col("at.place").cast("int").alias("hit"))
