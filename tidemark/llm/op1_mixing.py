"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Everything here is DataFrame work; texts are never shuffled. A source's target is its weight's part of
the mix, but at most `cap` times what the source holds; what is cut off goes to the other sources by
weight, again and again, until no target is above its cap. The level at which that ends is found in
closed form: with the sources sorted by cap/weight, it is the largest quotient of the words that remain
once all sources before one are full and the weight from that one on.

A source whose target is e times its size is taken floor(e) times whole. The rest of the target is taken
from a seeded order of its documents (md5 of seed and doc_id, then the text's hash): those up to a cut, each once
more; then, of those beyond the cut, the ones small enough for what is still missing, up to another cut; and
so on. Cuts are thresholds on that order, so documents are chosen by a join with the small table of sources. Each
cut is found by narrowing: sums over the 256 next ranges of the order say in which of them it lies, until
that range holds few rows, whatever the source's size. Rows equal in doc_id and text have one place; where the cut falls on
them, they alone are numbered, in the order of a hash of all columns, and as many as fit are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, fresh, numbered, set_aside, stored, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "tidemark"
CUTS = 3
#: Hex digits of the order by which a range is narrowed, and the rows that are few enough to be summed one by one.
RANGE_DIGITS, FEW = 2, 20_000
ADDED = ("size", "source_size", "target", "times", "taken")
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def order_key(seed: str) -> Column:
    """A document's place in the seeded order; rows of equal (or no) doc_id are told apart by their texts."""
    own = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return F.concat(own, F.lpad(F.lower(F.hex(F.xxhash64(whole_text()))), 16, "0"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to (source, source_size). The windows without a key hold one row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    leveled = (
        sources.withColumn("weight", weight)
        .withColumn("ratio", F.lit(cap) * F.col("source_size") / F.col("weight"))
        .withColumn("left", F.lit(share) * total - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(rest))
    )
    level = F.max("level").over(Window.partitionBy(F.lit(1)))
    return leveled.withColumn("at", level).select(
        "source", "source_size", F.least(F.lit(cap) * F.col("source_size"), F.col("at") * F.col("weight")).alias("target")
    )


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _cut(sizes: DataFrame, need: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, cut, edge, fit, got) for each source of need(source, need) that has rows in sizes(source, place, size).

    Rows before the place `cut` make `got` words, at most `need`, together with `fit` of those at `edge`.
    """
    at = scratch.stored(need.select(F.col("source").alias("s"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"), "need"), "at")
    ends, digits = None, 0
    while True:
        inside = sizes.join(at, _same("source", "s") & F.col("place").startswith(F.col("prefix"))).drop("s")
        by_range = inside.groupBy("source", "before", "need", F.substring("place", 1, digits + RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("in_range"), F.count("*").alias("n"))
        # at most 16 ** RANGE_DIGITS rows of a source
        running = F.sum("in_range").over(Window.partitionBy("source").orderBy("range"))
        sums = scratch.stored(by_range.withColumn("upto", F.col("before") + running), "sums")
        crossed = sums.filter("upto > need").groupBy("source").agg(F.min(F.struct("range", "upto", "in_range", "n")).alias("x")).select("source", "x.*")
        whole = sums.groupBy("source").agg(F.max("upto").alias("all"), F.first("need").alias("need"))
        found = scratch.stored(whole.join(crossed.withColumnRenamed("source", "s"), _same("source", "s"), "left").drop("s"), "found")
        done = found.filter("range is null").select("source", F.lit("~").alias("cut"), F.lit("").alias("edge"), F.lit(0).cast("long").alias("fit"), F.col("all").alias("got"))
        ends = done if ends is None else ends.union(done)
        digits += RANGE_DIGITS
        at = found.filter("range is not null").select(F.col("source").alias("s"), F.col("range").alias("prefix"), (F.col("upto") - F.col("in_range")).alias("before"), "need", "n")
        most = at.agg(F.max("n")).first()[0]
        if most is None:
            return ends
        if most <= FEW or digits >= 48:
            break
        at = at.drop("n")
    inside = sizes.join(at.drop("n"), _same("source", "s") & F.col("place").startswith(F.col("prefix"))).drop("s")
    by_place = inside.groupBy("source", "before", "need", "place").agg(F.sum("size").alias("in_place"), F.count("*").alias("n"))
    upto = F.col("before") + F.sum("in_place").over(Window.partitionBy("source").orderBy("place"))
    edge = by_place.withColumn("upto", upto).filter("upto > need").groupBy("source").agg(F.min(F.struct("place", "upto", "in_place", "n", "need")).alias("x")).select("source", "x.*")
    size = F.col("in_place") / F.col("n")  # rows of one place have one text
    fit = F.floor((F.col("need") - F.col("upto") + F.col("in_place")) / size)
    return ends.union(edge.select("source", F.col("place").alias("cut"), F.col("place").alias("edge"), fit.cast("long"), (F.col("upto") - F.col("in_place") + fit * size).cast("long")))


_BAND = "struct<most:bigint,cut:string,edge:string,fit:bigint>"


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, cuts: int = CUTS
) -> DataFrame:
    """docs with size, source_size, target, times and taken added (columns of these names are replaced).

    weights go to the sources in code point order, null last, again from the first when they run out.
    times says how often the mix takes the whole document, taken how many words that makes. A null or
    empty text has size 0; a null source is a source; repeated rows and equal or null ids are rows like others; an
    empty table gives an empty one; other columns stay, whatever their names; texts of any length are counted whole. Sources
    come within one document of their target; of rows equal in id and text as many are taken as fit; no row is taken more than ceil(cap) times. The table
    of sources is sorted as a whole, so it should have no more than some millions of rows.
    """
    docs = docs.drop(*ADDED)
    with Scratch(docs.sparkSession) as scratch:
        # bands: what of a source is taken once more: the documents of at most `most` words before `cut` in the order
        sizes = scratch.stored(docs.select("source", order_key(seed).alias("place"), n_words(whole_text()).alias("size")), "sizes")
        plan = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        plan = plan.withColumn("whole", whole.cast("int")).withColumn("need", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
        left, bands = sizes.filter("size > 0"), plan.withColumn("bands", F.array().cast(f"array<{_BAND}>"))
        for k in range(cuts):
            need = scratch.stored(bands, "bands")
            last = F.element_at("bands", -1) if k else F.lit(None).cast(_BAND)
            bounds = need.select(F.col("source").alias("s"), "need", last.alias("last"))
            beyond = F.col("last").isNull() | (F.col("size") > F.col("last.most")) | (F.col("place") > F.col("last.cut")) | ((F.col("place") == F.col("last.cut")) & (F.col("last.fit") == 0))
            left = left.join(bounds, _same("source", "s")).filter((F.col("size") <= F.col("need")) & beyond).select("source", "place", "size")
            cut = _cut(left, need.select("source", "need"), scratch).withColumnRenamed("source", "s")
            none = F.struct(F.lit(-1).cast("long").alias("most"), F.lit("").alias("cut"), F.lit("").alias("edge"), F.lit(0).cast("long").alias("fit"))
            band = F.when(F.col("cut").isNotNull(), F.struct(F.col("need").alias("most"), "cut", "edge", "fit")).otherwise(none)
            bands = need.join(cut, _same("source", "s"), "left").select(
                "source", "source_size", "target", "whole", F.array_append("bands", band).alias("bands"), (F.col("need") - F.coalesce("got", F.lit(0))).alias("need")
            )
        plan = stored(bands, "mix")
    s, place, whole, bands, number = fresh(docs, "mix_source", "mix_place", "mix_whole", "mix_bands", "mix_number")
    plan = plan.select(F.col("source").alias(s), "source_size", "target", F.col("whole").alias(whole), F.col("bands").alias(bands))
    sized = docs.withColumn("size", n_words(whole_text())).withColumn(place, order_key(seed)).join(plan, F.col("source").eqNullSafe(F.col(s)))
    at_edge = lambda b: (F.col("size") <= b["most"]) & (F.col(place) == b["edge"]) & (b["fit"] > 0)
    if plan.filter(F.exists(bands, lambda b: b["fit"] > 0)).isEmpty():
        sized = sized.withColumn(number, F.lit(0).cast("long"))
    else:  # cuts among equal rows: these are numbered
        tied = F.exists(bands, at_edge)
        equal = numbered(stored(sized.filter(tied).drop(s, "source_size", "target", whole, bands), "tied"), ["source", place], number)
        apart = sized.filter(~tied).withColumn(number, F.lit(0).cast("long"))
        sized = apart.unionByName(equal.join(plan, F.col("source").eqNullSafe(F.col(s))))
    taken = lambda b: ((F.col("size") <= b["most"]) & (F.col(place) < b["cut"])) | (at_edge(b) & (F.col(number) < b["fit"]))
    chosen = F.exists(bands, taken) & (F.col("size") > 0)
    return (
        sized.withColumn("times", F.col(whole) + chosen.cast("int"))
        .withColumn("taken", (F.col("size") * F.col("times")).cast("long"))
        .select(*docs.columns, *ADDED)
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs.

    A column of docs that mix() would replace (size, source_size, target, times, taken) is kept here.
    """
    aside, back = set_aside(docs, ADDED)
    mixed = mix(aside, **options).filter("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return mixed.drop(*ADDED).withColumnsRenamed(back).select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('tidemark|' || coalesce(doc_id::VARCHAR, 'null')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
lev AS (
  SELECT *, 2.0 * source_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
tgt AS (
  SELECT source, source_size,
         least(2.0::DOUBLE * source_size, (SELECT max(level) FROM lev) * weight)::DOUBLE AS target
  FROM lev),
p0 AS (
  SELECT s.doc_id, s.source, s.place, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
         false AS extra, floor(t.target - (CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END) * t.source_size)::BIGINT AS need
  FROM sizes s JOIN tgt t ON s.source IS NOT DISTINCT FROM t.source)
"""
for _k in range(CUTS):
    SQL += f""",
c{_k} AS (
  SELECT *, NOT extra AND size > 0 AND size <= need AND
    sum(CASE WHEN NOT extra AND size > 0 AND size <= need THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) <= need AS now
  FROM p{_k}),
p{_k + 1} AS (
  SELECT doc_id, source, place, size, source_size, target, whole, extra OR now AS extra,
         (need - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS need
  FROM c{_k})"""
SQL += f"\nSELECT doc_id, size, source_size, target, (size * (whole + extra::INT))::BIGINT AS taken FROM p{CUTS}"
