"""One position at a time: which rows of a series come to turn, where each keeps the series busy until it ends.

A row is taken if it begins after the last taken one has ended. A series is cut into blocks of bars. Within a block a fold
over its rows tells for each of them when a chain that takes it leaves the block; such an end leads to the first row
after it, in a later block. These links are followed in rounds of joins, each twice as far as the one before, so a
series of n blocks needs log2 n rounds and no task ever holds more than a block's rows. A block then has at most one
row at which the chain comes in, from where a second fold takes its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.bars import SERIES

#: Bars in a block, as a power of two.
BITS = 12

#: When a chain that takes the row leaves its block; items are in order.
_OUTS = """transform(aggregate(reverse(items), cast(array() as array<struct<begins:bigint,out:bigint>>),
  (later, x) -> concat(array(named_struct('begins', x.begins, 'out', coalesce(get(filter(later, y -> y.begins > x.ends), 0).out, x.ends))), later)), y -> y.out)"""
#: Places of the rows that are taken, from the one at which the chain comes in; null where it doesn't.
_TAKEN = """aggregate(items, named_struct('place', 0, 'busy', cast(-1 as bigint), 'taken', cast(array() as array<int>)),
  (s, x) -> if(s.place >= came_in AND x.begins > s.busy, named_struct('place', s.place + 1, 'busy', x.ends, 'taken', concat(s.taken, array(s.place))),
    named_struct('place', s.place + 1, 'busy', s.busy, 'taken', s.taken)), s -> s.taken)"""
_LINK = ("block", "out")


def _links(blocks: DataFrame, bits: int) -> DataFrame:
    """SERIES, block, out, to_block, to_place, to_out: from each end at which a block can be left to the row that is next."""
    ends = blocks.select(*SERIES, "block", F.explode(F.array_distinct("outs")).alias("out"))
    ends = ends.withColumn("at", F.greatest(F.shiftright("out", bits), F.col("block")))
    # the first block with rows after one: blocks and those asked for in order, as many as a series has blocks
    marks = blocks.select(*SERIES, "block", F.struct("block", F.col("outs")[0].alias("out")).alias("first"))
    asked = marks.unionByName(ends.select(*SERIES, F.col("at").alias("block")).distinct(), allowMissingColumns=True)
    after = asked.groupBy(*SERIES, "block").agg(F.first("first", ignorenulls=True).alias("first"))
    after = after.selectExpr(*SERIES, "block AS at", f"first_value(first, true) OVER (PARTITION BY {', '.join(SERIES)} ORDER BY block ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next")
    held = blocks.select(*SERIES, F.col("block").alias("at"), "items", "outs")
    met = ends.join(held, [*SERIES, "at"], "left").withColumn("place", F.expr("if(at > block, array_position(transform(items, y -> y.begins > out), true) - 1, -1)"))
    found = F.col("place") >= 0
    to = F.when(found, F.struct(F.col("at").alias("block"), F.col("place").cast("int").alias("place"), F.expr("get(outs, cast(place as int))").alias("out")))
    to = F.coalesce(to, F.when(F.col("next").isNotNull(), F.struct(F.col("next.block").alias("block"), F.lit(0).alias("place"), F.col("next.out").alias("out"))))
    return met.join(after, [*SERIES, "at"], "left").withColumn("to", to).filter("to IS NOT NULL").select(*SERIES, *_LINK, F.col("to.block").alias("to_block"), F.col("to.place").alias("to_place"), F.col("to.out").alias("to_out"))


def with_turns(rows: DataFrame, begins: str, ends: str, scale: str = "context_scale", bits: int = BITS) -> DataFrame:
    """rows with `taken`. begins and ends: columns of bars, from 0 on; a row without an end keeps nothing busy.

    Rows of a series count in order of begins, then of scale; of equal ones that which ends first comes first. No row without begins is taken.
    """
    from tidemark.plans.base import stored

    start = F.col(begins).cast("long")
    item = F.struct(start.alias("begins"), F.col(scale).alias("scale"), F.coalesce(F.col(ends).cast("long"), start - 1).alias("ends"), F.struct(*rows.columns).alias("row"))
    blocks = rows.groupBy(*SERIES, F.shiftright(start, bits).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = stored(blocks.withColumn("outs", F.when(F.col("block").isNotNull(), F.expr(_OUTS))))
    some = blocks.filter("block IS NOT NULL")
    first = some.groupBy(*SERIES).agg(F.min(F.struct("block", F.col("outs")[0].alias("out"))).alias("f"), F.count("*").alias("n"))
    came = first.select(*SERIES, "f.*", F.lit(0).alias("place"))
    several = first.filter("n > 1").select(*SERIES)
    if several.head(1):
        links = stored(_links(some.join(several, list(SERIES), "left_semi"), bits))
        while True:
            new = stored(came.join(links, [*SERIES, *_LINK]).select(*SERIES, F.col("to_block").alias("block"), F.col("to_out").alias("out"), F.col("to_place").alias("place")))
            if not new.head(1):
                break
            came = came.unionByName(new)
            onward = links.select(*SERIES, F.col("block").alias("to_block"), F.col("out").alias("to_out"), F.struct("to_block", "to_place", "to_out").alias("to"))
            links = stored(links.select(*SERIES, *_LINK, "to_block", "to_out").join(onward, [*SERIES, "to_block", "to_out"]).select(*SERIES, *_LINK, "to.*"))
    entered = blocks.join(came.select(*SERIES, "block", F.col("place").alias("came_in")), [*SERIES, "block"], "left").withColumn("taken", F.expr(_TAKEN))
    placed = entered.select("taken", F.posexplode("items").alias("place", "item"))
    return placed.select("item.row.*", F.expr("array_contains(taken, place)").alias("taken"))
