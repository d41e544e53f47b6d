"""A Merkle manifest of a dataset, with a proof for each row.

A row is a leaf; a source's leaves, by id, make a tree in which every three nodes in a row become one; the sources'
roots make the last tree. Rows get their place by a sort into ranges and the counts of ranges, so no task holds a
source. Trees grow a page at a time: the 81 nodes of a page give all four levels above them at once, and what is on
top of the pages is the next round's input; a round for every four levels, each a shuffle of 1/81 of the one before.

Proofs go the other way. In each round a node works out from its index and its source's size which siblings it needs
within its page, explodes these coordinates, joins them with the materialised nodes, and puts what it finds in order; what
lies above its page comes from the page's own proof, found in the round before. So whatever a source's size, a node
is asked for by at most 80 others, and a page's proof by at most 81. A leaf then folds its digest with its siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, stored

#: Nodes that become one, and how many levels a round adds.
ARITY, LEVELS = 3, 4
PAGE = ARITY**LEVELS
#: The number of the tree over the sources' roots; sources are numbered from 0.
TOP = -1


def leaf(text: Column) -> Column:
    """The digest of a row, in hex, with this text."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]), 256)


def tampered() -> Column:
    """Whether a row's text loses its line ends in the test of the proofs; a row without an id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and the leaf that is folded; digests as bytes, and what tells identical rows apart."""
    folded = F.when(tampered(), F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.unhex(leaf(F.col("text"))).alias("leaf"), F.unhex(leaf(folded)).alias("folded"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def placed(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows with `tree` (the source's number: null first, then by bytes) and `idx` (by doc_id, null first, then by leaf),
    and the trees with their `size` and source.

    The sorted ranges are written with a number that counts within them, so only their bounds are summed, not rows.
    """
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "row")]
    # identical rows (a third of the table, perhaps) are told apart, so ranges are of one size
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("row")
    numbered = scratch.stored(ranged.withColumn("range", F.shiftright("at", 33)), "ranged")
    # a row for each source and range that meet; a range's sources are in order
    runs = numbered.groupBy("range", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    starts = runs.groupBy("source").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    # sources are numbered like rows: within the range in which they begin, after all that begin in earlier ones
    begun = starts.withColumn("range", F.shiftright("first", 33))
    per_range = begun.groupBy("range").agg(F.count("*").alias("n")).selectExpr("range", "sum(n) OVER (ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before")
    trees = begun.join(per_range, "range").selectExpr("source", "size", "coalesce(before, 0) + row_number() OVER (PARTITION BY range ORDER BY first) - 1 AS tree")
    trees = scratch.stored(trees, "trees")
    offsets = runs.selectExpr("range", "source", "first", "coalesce(sum(n) OVER (PARTITION BY source ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    known = offsets.join(trees, offsets.source.eqNullSafe(trees.source)).select("range", offsets.source, "first", "before", "tree", "size")
    known = scratch.stored(known, "runs").withColumnsRenamed({"range": "r", "source": "s"})
    found = numbered.join(known, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    return found.select("doc_id", "source", "leaf", "folded", "tree", "size", (F.col("before") + F.col("at") - F.col("first")).alias("idx")), trees


def _above(nodes: str) -> str:
    """The digests of the runs of an array of digests, as an array."""
    run = f"array_join(transform(slice({nodes}, i * {ARITY} + 1, {ARITY}), x -> lower(hex(x))), '')"
    return f"transform(sequence(0, cast(ceil(size({nodes}) / {ARITY}) as int) - 1), i -> unhex(sha2({run}, 256)))"


def grown(nodes: DataFrame) -> DataFrame:
    """One round: all levels above pages of nodes. nodes: tree, size (nodes of the tree on this level), idx, digest.

    Returns tree, size, page, and `levels`: LEVELS + 1 arrays, from the page's own nodes up; empty above the tree's root.
    """
    page = nodes.groupBy("tree", "size", F.expr(f"idx div {PAGE}").alias("page")).agg(F.expr("transform(array_sort(collect_list(struct(idx, digest))), x -> x.digest)").alias("l0"))
    width = "size"
    for k in range(1, LEVELS + 1):
        # the tree has come to one node below: it ends there
        page = page.withColumn(f"l{k}", F.expr(f"CASE WHEN {width} > 1 THEN {_above(f'l{k - 1}')} ELSE array() END"))
        width = f"ceil({width} / {ARITY})"
    return page.select("tree", "size", "page", F.array(*[f"l{k}" for k in range(LEVELS + 1)]).alias("levels"))


def node_table(pages: DataFrame) -> DataFrame:
    """tree, level (within the round), idx, digest of all nodes that may be siblings in a round."""
    each = pages.select("tree", "page", F.posexplode(F.slice("levels", 1, LEVELS)).alias("level", "digests"))
    first = F.expr(f"page * cast(power({ARITY}, {LEVELS} - level) as bigint)")
    return each.select("tree", "level", first.alias("first"), F.posexplode("digests").alias("i", "digest")).select("tree", "level", (F.col("first") + F.col("i")).alias("idx"), "digest")


def _width(level: str) -> str:
    """Nodes of the tree on a level of the round."""
    return f"cast(ceil(size / power({ARITY}, {level})) as bigint)"


#: Siblings that a node needs within its page: level and index, the others of each run on its way up.
_COORDINATES = f"""
filter(flatten(transform(sequence(0, {LEVELS - 1}), l -> transform(sequence(0, {ARITY - 1}), j -> struct(l AS level,
  (idx div cast(power({ARITY}, l + 1) as bigint)) * {ARITY} + j AS sibling, idx div cast(power({ARITY}, l) as bigint) AS own)))),
  c -> {_width('c.level')} > 1 AND c.sibling < {_width('c.level')} AND c.sibling <> c.own)"""
#: Levels that a node passes within its page before the tree's root.
_PASSED = f"size(filter(sequence(0, {LEVELS - 1}), l -> {_width('l')} > 1))"


def _hex(nodes: str) -> str:
    return f"array_join(transform({nodes}, x -> lower(hex(x.digest))), '')"


def steps_of(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """tree, idx, steps: for each level of the page that a node passes, what stands left and right of it in its run, in hex.

    members: tree, size, idx. A run of one has nothing on either side.
    """
    asked = members.select("tree", "size", "idx", F.explode_outer(F.expr(_COORDINATES)).alias("c")).select("tree", "size", "idx", "c.level", F.col("c.sibling").alias("sibling"))
    met = asked.join(nodes.select("tree", "level", F.col("idx").alias("sibling"), "digest"), ["tree", "level", "sibling"], "left")
    found = met.groupBy("tree", "size", "idx").agg(F.expr("array_sort(collect_list(CASE WHEN level IS NOT NULL THEN struct(level, sibling, digest) END))").alias("met"))
    side = lambda sign: _hex(f"filter(met, x -> x.level = l AND x.sibling {sign} idx div cast(power({ARITY}, l) as bigint))")
    passed = f"transform(slice(sequence(0, {LEVELS - 1}), 1, {_PASSED}), l -> struct({side('<')} AS left, {side('>')} AS right))"
    return found.select("tree", "size", "idx", F.expr(passed).alias("steps"))


def _rounds(nodes: DataFrame, most: int, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """(members, pages) of each round from the leaves up. most: the size of the largest tree."""
    out = []
    while True:
        pages = scratch.stored(grown(nodes), "pages")
        out.append((nodes.select("tree", "size", "idx"), pages))
        if most <= PAGE:
            return out
        most = -(-most // PAGE)
        up = pages.filter(f"size > {PAGE}")
        nodes = up.select("tree", F.expr(f"cast(ceil(size / {PAGE}) as bigint)").alias("size"), F.col("page").alias("idx"), F.expr(f"levels[{LEVELS}][0]").alias("digest"))


def _roots(rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """tree, digest of every tree's root: the last level that isn't empty, in the round in which the tree ends."""
    found = [pages.filter(f"size <= {PAGE}").select("tree", F.expr("element_at(filter(levels, x -> size(x) > 0), -1)[0]").alias("digest")) for _, pages in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_STEPS = "array<struct<left:string,right:string>>"


def paths(rounds: list[tuple[DataFrame, DataFrame]], ends: DataFrame, scratch: Scratch) -> DataFrame:
    """tree, idx, path of the first round's members, with the columns of `ends`. ends: tree, path, and what else belongs to a tree.

    path: steps (left and right, in hex) up to the tree's root and then those of the tree's end.
    """
    more = [c for c in ends.columns if c not in ("tree", "path")]
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        members, pages = rounds[k]
        own = steps_of(members, node_table(pages)).withColumn("page", F.expr(f"CASE WHEN size > {PAGE} THEN idx div {PAGE} ELSE -1 END"))
        last = ends.select("tree", F.lit(-1).cast("long").alias("page"), F.col("path").alias("rest"), *more)
        known = last if above is None else last.unionByName(above.select("tree", F.col("idx").alias("page"), F.col("path").alias("rest"), *more))
        found = own.join(known, ["tree", "page"]).select("tree", "idx", F.concat("steps", "rest").alias("path"), *more)
        above = found if k == 0 else scratch.stored(found, "paths")
    return above


def with_proofs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    docs: doc_id, source, lang, n_chars, text; other columns are left out. Where tampered() holds, the leaf that is folded is that of the
    text without its line ends. Leaves ascend by doc_id; null ids come first, equal ones go by their leaf; rows that are
    identical are leaves of their own. Null fields, empty and very long texts are hashed as they are. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        rows, trees = placed(scratch.stored(leaves(docs), "leaves"), scratch)
        rows = scratch.stored(rows, "placed")
        most, n_trees = trees.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
        by_source = _rounds(rows.select("tree", "size", "idx", F.col("leaf").alias("digest")), most, scratch)
        subroots = scratch.stored(_roots(by_source).withColumnRenamed("digest", "subroot"), "subroots")
        over = _rounds(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("size"), F.col("tree").alias("idx"), F.col("subroot").alias("digest")), n_trees, scratch)
        end = _roots(over).select("tree", F.array().cast(_STEPS).alias("path"), F.col("digest").alias("root"))
        upper = paths(over, end, scratch).select(F.col("idx").alias("tree"), "path", "root")
        ends = scratch.stored(upper.join(subroots, "tree"), "ends")
        found = rows.select("tree", "idx", "doc_id", "leaf", "folded").join(paths(by_source, ends, scratch), ["tree", "idx"])
        fold = "aggregate(path, lower(hex(folded)), (acc, x) -> sha2(concat(x.left, acc, x.right), 256))"
        out = found.select(
            "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
            F.expr("sha2(array_join(transform(path, x -> concat(x.left, x.right)), ''), 256)").alias("proof_sha256"), F.expr(fold).alias("folded_root"),
        )
        return stored(out.withColumn("verified", F.col("folded_root") == F.col("root")), "op11")


def _climb(tree: str, leaves_: str, levels: int, start: str) -> str:
    """CTEs for checking: the levels of trees, and a fold for each row of `start` (tree, idx, size, proof, folded) up to the root."""
    out, rows = "", start
    for k in range(levels):
        below = leaves_ if k == 0 else f"{tree}_n{k}"
        out += f"""
{tree}_r{k} AS MATERIALIZED (SELECT tree, idx // {ARITY} AS run, list(digest ORDER BY idx) AS d FROM {below} GROUP BY tree, idx // {ARITY} HAVING any_value(size) > 1),
{tree}_n{k + 1} AS MATERIALIZED (SELECT r.tree, run AS idx, sha256(array_to_string(d, '')) AS digest, (s.size + {ARITY} - 1) // {ARITY} AS size FROM {tree}_r{k} r JOIN (SELECT DISTINCT tree, size FROM {below}) s USING (tree)),
{tree}_p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (p.idx // {ARITY} AS idx, CASE WHEN d IS NULL THEN proof ELSE proof || array_to_string(d[:p.idx % {ARITY}], '') || array_to_string(d[p.idx % {ARITY} + 2:], '') END AS proof,
  CASE WHEN d IS NULL THEN folded ELSE sha256(array_to_string(d[:p.idx % {ARITY}], '') || folded || array_to_string(d[p.idx % {ARITY} + 2:], '')) END AS folded) FROM {rows} p LEFT JOIN {tree}_r{k} r ON r.tree = p.tree AND r.run = p.idx // {ARITY}),"""
        rows = f"{tree}_p{k + 1}"
    return out


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


def check_sql(levels: int = 13) -> str:
    """The same level by level for all rows at once, and the checksum from its definition. levels: enough for 3^levels leaves a source."""
    table = "list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    crc = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c // 256, crc_table[xor(c, b) % 256 + 1])), 4294967295)"
    roots = " UNION ALL ".join(f"SELECT tree, digest FROM {'leaf' if k == 0 else f'own_n{k}'} WHERE size = 1" for k in range(levels + 1))
    tops = " UNION ALL ".join(f"SELECT digest FROM {'subroot' if k == 0 else f'top_n{k}'} WHERE size = 1" for k in range(levels + 1))
    return f"""
WITH crc AS (SELECT {table} AS crc_table),
row0 AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS folded FROM documents, crc),
row1 AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size FROM row0),
leaf AS (SELECT tree, idx, leaf AS digest, size FROM row1), start AS (SELECT doc_id, leaf, tree AS own, tree, idx, '' AS proof, folded FROM row1),
{_climb("own", "leaf", levels, "start")}
subroots AS MATERIALIZED ({roots}),
subroot AS (SELECT -1 AS tree, tree AS idx, digest, count(*) OVER () AS size FROM subroots),
up AS (SELECT p.* REPLACE (-1 AS tree, p.own AS idx), s.digest AS subroot FROM own_p{levels} p JOIN subroots s ON s.tree = p.own),
{_climb("top", "subroot", levels, "up")}
root AS ({tops})
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root.digest AS verified FROM top_p{levels}, root"""


SQL = check_sql()


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_proofs(documents(spark, sf_dir))
