r"""Benchmark decontamination by spaced seeds, in DataFrame work alone.

Tokens are the runs of letters and digits of the lower-cased text. A mask names the positions of a short
span that count; the others may hold anything. For each mask and place the hash of the counting tokens is
a seed. Seeds of documents are joined with those of the benchmark, and around each hit the two token
sequences are compared place by place: a window of WINDOW tokens (or the whole item, if that is shorter)
that holds the hit and in which at most a quarter of the tokens differ is an overlap.

The masks are chosen so that every accepted window has a hit within it: result rows are those of comparing all
windows of all documents with all items. Shorter items have masks of their own, as their windows are shorter.
Items of fewer than SHORTEST tokens stand in texts by chance; they are found only in documents that have
nothing else.

A text is cut into pieces of PIECE places, each with the words around it that a window can reach, and a hit keeps
only the words around its place: a generated stage holds all hits of its input row at once, so with the whole
text beside each of them a long text that repeats an item would need memory by the square of its length.

The benchmark's seeds are broadcast only where a count shows that they are few; then a document's seeds
are made, looked up and verified in one stage, and nothing but overlaps is shuffled. A place's seed is looked up first and
its items are joined after that, so a piece's hits are few, however many items share a seed. Where seeds are many,
they are joined by a shuffle, and the pieces of the hits fetched by a second join; rows are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, fresh, stored, whole_text

#: By the shortest item that a set is for; 1: the token at this place counts. Within the fewest tokens that an
#: overlap can be (the item's, at most WINDOW), each set hits every pattern of differing tokens that is accepted.
MASKS = {
    5: ("1101", "1011"), 6: ("11101", "10111"), 8: ("11011", "11000011", "10100101"),
    9: ("110111", "1111001", "11001011", "10001111"), 12: ("110111", "110001011", "111010001", "111011"), 13: ("11101011", "110100111", "1110001011", "1111011", "10001001111"),
}
SHORTEST = min(MASKS)
WINDOW = 13
REACH = WINDOW - 1
#: Places of a text in one row.
PIECE = 1024
#: Seeds of the benchmark, a few dozen bytes each, that are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 300_000
DIFFER = 4  # one token in so many may differ
SPLIT = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPLIT, -1), "")


def _places(mask: str) -> list[int]:
    return [i for i, x in enumerate(mask) if x == "1"]


def _codes(words: Column) -> Column:
    """Hashes of the words, so that each word is hashed once and not for every mask and place that it counts in."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(codes: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(codes, at + p) for p in _places(mask)))


def _seeds(codes: Column, at: Column, n: Column, masks: list[str]) -> Column:
    """The seeds at a place; null where a mask reaches beyond the end."""
    return F.array(*(F.when(at + len(m) <= n, _seed(codes, at, m)) for m in masks))


def _items(benchmark: DataFrame) -> DataFrame:
    """The benchmark's items with their words; items without a word match nothing and are left out."""
    return benchmark.select(F.col("item_id"), tokens(whole_text()).alias("item")).withColumn("n", F.size("item")).filter("n > 0")


def _set_of(n: int) -> int:
    """The set of masks for an item of n tokens."""
    return max(k for k in MASKS if k <= n)


def _whole_seed(words: Column) -> Column:
    """The seed of a short item, or of a document as short."""
    return F.xxhash64(F.lit("whole"), F.array_join(words, " "))


def _item_seeds(items: DataFrame, sets: list[int]) -> DataFrame:
    """(seed, span, item_id, item_at) for each place of an item and each mask of its set."""
    at = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("item_at")
    own = F.array_max(F.filter(F.array(*(F.lit(k) for k in MASKS)), lambda k: k <= F.col("n")))
    parts = [items.filter(F.col("n") < SHORTEST).select(_whole_seed(F.col("item")).alias("seed"), F.col("n").alias("span"), "item_id", F.lit(0).alias("item_at"))]
    for k in sets:
        placed = items.filter(own == k).select("item_id", _codes(F.col("item")).alias("codes"), "n", at)
        found = placed.select("item_id", "item_at", F.posexplode(_seeds(F.col("codes"), F.col("item_at"), F.col("n"), list(MASKS[k]))).alias("m", "seed")).filter("seed is not null")
        parts.append(found.select("seed", F.get(F.array(*(F.lit(len(m)) for m in MASKS[k])), F.col("m")).alias("span"), "item_id", "item_at"))
    return reduce(DataFrame.union, parts)


def _pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, n, first, words, codes): a row for PIECE places of a text from `start` on; n is the text's
    number of words. `words` begins REACH words before (or at the text's first), at place `first`, and ends REACH behind."""
    rows = docs.select("doc_id", F.md5(whole_text()).alias("text_key"), tokens(whole_text()).alias("words"))
    rows = rows.withColumns({"n": F.size("words"), "codes": _codes(F.col("words"))})

    def piece(start: Column) -> Column:
        first = F.greatest(start - REACH, F.lit(0))
        part = [F.slice(c, first + 1, start - first + PIECE + REACH).alias(c) for c in ("words", "codes")]
        return F.struct(start.alias("start"), first.alias("first"), *part)

    cut = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PIECE)), piece))
    return rows.select("doc_id", "text_key", "n", F.explode(cut).alias("piece")).select("doc_id", "text_key", "piece.start", "n", "piece.first", "piece.words", "piece.codes")


def _near(at: Column) -> list[Column]:
    """The words around a place of a piece, and where among them it is."""
    own = at - F.col("first")
    begin = F.greatest(own - REACH, F.lit(0))
    return [F.slice("words", begin + 1, own - begin + WINDOW).alias("near"), (own - begin).alias("near_at")]


def _best(words: Column) -> Column:
    """The most equal tokens in a window of `width` that holds the hit; place `near_at` of the words is item place `item_at`."""
    at, item_at, span, n, width = (F.col(c) for c in ("near_at", "item_at", "span", "n", "width"))
    starts = F.sequence(F.greatest(F.lit(0), item_at + span - width), F.least(item_at, n - width))
    equal = lambda a: F.size(F.filter(F.sequence(a, a + width - 1), lambda k: F.get(words, at - item_at + k) == F.get(F.col("item"), k)))
    return F.array_max(F.transform(starts, equal))


def overlaps(docs: DataFrame, benchmark: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, text_key, item_id, doc_start, matched): documents that hold part of an item.

    doc_start is the first document token that lies at the item's first one (negative if the item begins
    before the document), matched the most equal tokens of a window. text_key is the text's md5.
    Null and empty texts hold nothing, texts of any length are read whole. Rows with equal doc_id and text give one
    row for each item; a null doc_id stays null. Items with equal texts are found alike. Further columns of either
    table are ignored.
    """
    items = _items(benchmark)
    lengths = [r.n for r in items.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]  # at most WINDOW
    sets = sorted({_set_of(n) for n in lengths if n >= SHORTEST})
    masks = list(dict.fromkeys(m for k in sets for m in MASKS[k]))
    seeds = stored(_item_seeds(items, sets), "seeds")
    items = items.withColumn("width", F.least(F.lit(WINDOW), F.col("n")))
    pieces = _pieces(docs)
    placed = pieces.withColumn("at", F.explode(F.sequence("start", F.least(F.col("start") + PIECE, F.col("n")) - 1)))
    own, at = F.col("at") - F.col("first"), F.col("at")
    of_masks = _seeds(F.col("codes"), own, F.size("codes"), masks) if masks else F.array().cast("array<bigint>")
    short = F.when((at == 0) & (F.col("n") < SHORTEST), _whole_seed(F.col("words")))
    seeded = placed.withColumn("seed", F.explode(F.array_append(of_masks, short))).filter("seed is not null")
    shift = (at - F.col("item_at")).alias("shift")
    if few := seeds.count() <= most_broadcast:
        hits = seeded.join(F.broadcast(seeds.select("seed")), "seed", "left_semi").select("doc_id", "text_key", "at", "seed", *_near(at))
        each = hits.join(F.broadcast(seeds), "seed").withColumn("shift", shift)
    else:
        found = seeded.select("doc_id", "text_key", "start", "at", "seed").join(seeds, "seed").select("doc_id", "text_key", "start", "at", "item_id", shift, "item_at", "span").distinct()
        hits = stored(found, "hits").withColumnsRenamed({"doc_id": "d", "text_key": "t", "start": "s"})
        texts = pieces.drop("n", "codes").dropDuplicates(["doc_id", "text_key", "start"])
        same = (F.col("text_key") == F.col("t")) & (F.col("start") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))
        each = hits.join(texts, same).select("doc_id", "text_key", "item_id", "shift", "item_at", "span", *_near(at))
    matched = each.join(F.broadcast(items) if few else items, "item_id").withColumn("matched", _best(F.col("near")))
    verified = matched.filter(F.col("matched") >= F.col("width") - F.floor(F.col("width") / DIFFER))
    return verified.groupBy("doc_id", "text_key", "item_id").agg(F.min("shift").alias("doc_start"), F.max("matched").alias("matched"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no part of an item, with their columns; null and empty texts stay."""
    (key,) = fresh(docs, "leak_key")
    found = stored(overlaps(docs, benchmark).select(F.col("text_key").alias(key)).distinct(), "leaks")
    return docs.join(found, F.md5(whole_text()) == F.col(key), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "doc_start", "matched")


def _sql_seed(words: str, at: str, mask: str) -> str:
    return f"'{mask} ' || " + " || ' ' || ".join(f"{words}[{at} + {p + 1}]" for p in _places(mask))


def _sql_seeds(words: str, at: str, masks: list[str]) -> str:
    """A list of the seeds at a place, null where a mask reaches beyond the end."""
    return "[" + ", ".join(f"CASE WHEN {at} + {len(m)} <= len({words}) THEN {_sql_seed(words, at, m)} END" for m in masks) + "]"


def _sql_spans(masks: tuple[str, ...]) -> str:
    return "[" + ", ".join(str(len(m)) for m in masks) + "]"


_ALL_MASKS = list(dict.fromkeys(m for masks in MASKS.values() for m in masks))
_BY_LENGTH = " ".join(f"WHEN n >= {k} THEN {_sql_seeds('item', 'item_at', list(MASKS[k]))}" for k in sorted(MASKS, reverse=True))
_SPANS = " ".join(f"WHEN n >= {k} THEN {_sql_spans(MASKS[k])}" for k in sorted(MASKS, reverse=True))

SQL = rf"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS words FROM documents),
items AS (
  SELECT item_id, item, len(item) AS n, least({WINDOW}, len(item)) AS width
  FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS item FROM benchmark) WHERE len(item) > 0),
placed AS (SELECT doc_id, words, unnest(range(len(words))) AS pos FROM docs),
item_placed AS (SELECT *, unnest(range(n)) AS item_at FROM items WHERE n >= {SHORTEST}),
item_seeds AS (SELECT item_id, item, n, width, item_at, unnest(CASE {_BY_LENGTH} END) AS seed, unnest(CASE {_SPANS} END) AS span FROM item_placed),
seeds AS (
  SELECT * FROM item_seeds WHERE seed IS NOT NULL
  UNION ALL SELECT item_id, item, n, width, 0, 'whole ' || array_to_string(item, ' '), n FROM items WHERE n < {SHORTEST}),
doc_seeds AS (
  SELECT doc_id, words, pos, unnest({_sql_seeds("words", "pos", _ALL_MASKS)}) AS seed FROM placed
  UNION ALL SELECT doc_id, words, 0, 'whole ' || array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND {SHORTEST - 1}),
hits AS (
  SELECT doc_id, item_id, pos - item_at AS doc_start, width,
         list_max(list_transform(range(greatest(0, item_at + span - width), least(item_at, n - width) + 1),
           lambda a: len(list_filter(range(a, a + width), lambda k: pos - item_at + k >= 0 AND words[pos - item_at + k + 1] = item[k + 1])))) AS matched
  FROM doc_seeds JOIN seeds USING (seed))
SELECT doc_id, item_id, min(doc_start)::INTEGER AS doc_start, max(matched)::INTEGER AS matched
FROM hits WHERE matched >= width - width // {DIFFER} GROUP BY doc_id, item_id
"""
