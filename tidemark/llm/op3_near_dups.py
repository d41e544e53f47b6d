"""Near-duplicate documents by BagMinHash signatures, banding, and exact verification.

A document is the multiset of its runs of five words (a shorter one is a single run), so how often a run
stands in it counts. Each run has Poisson processes over the levels of its weight, of rate 1 a level; each
point has a register at random, and a register's value is the first point that hits it at a level below the
run's weight. Two documents agree in a register with a probability of their weighted Jaccard likeness. The
levels 0, 1, 2-3, 4-7, 8-15... are a process each, so a run has about log2(weight) of them; of the last one,
which the weight cuts, a point counts if its level, drawn with it, lies below the weight. A process's points
come in ascending order, so only those below a bound are made; it is raised until each register has its point.

Equal texts are one class from the start. Of the rest, REGISTERS values in bands of ROWS make buckets, and
likeness of multisets is verified exactly. A bucket is never turned into all its pairs: its hub, the member
that shares most buckets with most others, is compared with each member. Members that don't end up in the
hub's class are then compared with all others of their bucket, in blocks of bounded size; there a pair is
verified if their classes still differ, the bucket is their first common one, and a bound on what they can
share (by counts of their runs in BINS ranges of the hash) reaches LIKE, which leaves out no pair that is alike.

Classes are connected components of verified links, found by passing on the smallest label along links
until nothing changes; every round is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, cut_by, documents, fresh, joined_by, stored, whole_text

WORDS = 5
LIKE = 0.8
REGISTERS, ROWS = 96, 4
BINS = 256
BLOCK = 1024

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = [np.uint64(x) for x in (0x100000001B3, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def runs(text: str) -> np.ndarray:
    """A hash for each run of WORDS words, in order; one for a shorter text, none for one without words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(h))):
        total += _mixed(h[i : i + n] + _ODD[i % len(_ODD)]) * _ODD[(i + 1) % len(_ODD)]
    return _mixed(total)


def _processes(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """(state, owner, first level, levels, weight) of each process: a run's levels 0, 1, 2-3, 4-7... up to its weight."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(hashes)))
    shells = np.where(weight > 1, np.ceil(np.log2(weight)), 0).astype(np.int64) + 1
    of = np.repeat(np.arange(len(at)), shells)
    shell = np.arange(len(of)) - np.repeat(np.cumsum(shells) - shells, shells)
    levels = np.where(shell > 0, 1 << np.maximum(shell - 1, 0), 1)
    return _mixed(hashes[at][of] + (shell.astype(np.uint64) + np.uint64(1)) * _A), owner[at][of], np.where(shell > 0, levels, 0), levels, weight[of]


def signatures(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash registers (as hashes of their first points) of n documents; hashes and owner: a row for each run.

    Each document needs a run.
    """
    total = np.bincount(owner, minlength=n)
    state, owner, lowest, levels, weight = _processes(hashes, owner)
    # points come at rate 1 a level; this bound leaves a register empty once in e**4 documents
    bound = REGISTERS * (np.log(REGISTERS) + 4) / total
    values, out = np.full(n * REGISTERS, np.inf), np.zeros(n * REGISTERS, np.uint64)
    time, live, count = np.zeros(len(state)), np.arange(len(state)), 0
    unit = lambda x: ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    while True:
        held = []
        while len(live):
            point = _mixed(state[live] + np.uint64(count * int(_B) & 0xFFFFFFFFFFFFFFFF))
            time[live] -= np.log(unit(point)) / levels[live]
            inside = time[live] <= bound[owner[live]]
            live, point = live[inside], point[inside]
            level = lowest[live] + np.minimum((unit(_mixed(point + _C)) * levels[live]).astype(np.int64), levels[live] - 1)
            hit = np.flatnonzero(level < weight[live])
            slot = owner[live[hit]] * REGISTERS + (_mixed(point[hit] + _A) % np.uint64(REGISTERS)).astype(np.int64)
            held.append((slot, time[live[hit]], point[hit]))
            count += 1
        if held:
            slot, t, s = (np.concatenate(x) for x in zip(*held, strict=True))
            np.minimum.at(values, slot, t)
            hit = t == values[slot]
            out[slot[hit]] = s[hit]
        empty = np.isinf(values).reshape(n, REGISTERS).any(axis=1)
        if not empty.any():
            return out.reshape(n, REGISTERS)
        # documents with an empty register start again under twice the bound
        again = empty[owner]
        bound = np.where(empty, 2 * bound, -1.0)
        values.reshape(n, REGISTERS)[empty] = np.inf
        time[again], live, count = 0.0, np.flatnonzero(again), 0


def bands(registers: np.ndarray) -> np.ndarray:
    """A hash for each band of each document."""
    n = REGISTERS // ROWS
    out = np.zeros((len(registers), n), np.uint64)
    for i in range(ROWS):
        out = _mixed(out + registers[:, i::ROWS][:, :n] * _ODD[i])
    return _mixed(out + np.arange(n, dtype=np.uint64) * _A).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            own = [runs(t) for t in batch["text"].to_pylist()]
            some = [i for i, h in enumerate(own) if len(h)]
            if not some:
                continue
            registers = signatures(np.concatenate([own[i] for i in some]), np.repeat(np.arange(len(some)), [len(own[i]) for i in some]), len(some))
            keys = bands(registers)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({"id": batch["id"].take(pa.array(some, pa.int64())), "bands": lists})


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted run hashes, four bytes each; that two runs of a pair meet in one by chance doesn't matter."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            data = [np.sort((runs(t.as_py()) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_pydict({"id": batch["id"], "runs": pa.array(data, pa.binary())})


def likeness(a: bytes, b: bytes) -> float:
    """Jaccard likeness of two sorted multisets of four-byte hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if min(len(x), len(y)) < LIKE * max(len(x), len(y)):
        return 0.0
    both = np.concatenate([_numbered(x), _numbered(y)])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _numbered(x: np.ndarray) -> np.ndarray:
    """Makes a sorted multiset a set: each hash with the number of its repeat."""
    out = x.astype(np.uint64) << np.uint64(32)
    same = np.flatnonzero(x[1:] == x[:-1]) + 1
    if len(same):
        first = np.ones(len(x), bool)
        first[same] = False
        at = np.flatnonzero(first)
        out += (np.arange(len(x)) - np.repeat(at, np.diff(np.append(at, len(x))))).astype(np.uint64)
    return out


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, label) for every id in links(a, b): label is the smallest id that it is connected with.

    Each round passes the smallest label to neighbours and to the label itself, so chains halve.
    """
    both = scratch.stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = scratch.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = joined_by(both, labels.select(F.col("id").alias("b"), "label"), "b", "a").select(F.col("a").alias("id"), "label")
        up = joined_by(labels, labels.select(F.col("id").alias("label"), F.col("label").alias("top")), "label", "id")
        # what a member has heard goes to its label as well, so that a class's old root learns the new one
        heard = near.groupBy("id").agg(F.min("label").alias("heard")).join(labels, "id")
        told = heard.select(F.explode(F.array(F.struct("id", F.col("heard").alias("label")), F.struct(F.col("label").alias("id"), F.col("heard").alias("label")))).alias("x")).select("x.*", F.lit(None).cast("binary").alias("old"))
        lifted = up.select("id", F.least("top", "label").alias("label"), F.col("label").alias("old"))
        new = told.union(lifted).groupBy("id").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        new = scratch.stored(new, "labels")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def _verify(pairs: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of pairs(a, b) whose texts are alike; b has few pairs, a may be the hub of many."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.stored(texts.join(wanted, "id").select("id", "text").mapInArrow(_as_bytes, "id binary, runs binary"), "runs")

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([likeness(x, y) >= LIKE for x, y in zip(a, b, strict=True)], index=a.index, dtype=bool)

    left, right, on = cut_by(pairs, sets.select(F.col("id").alias("a"), F.col("runs").alias("runs_a")), "a", "b")
    joined = left.join(sets.select(F.col("id").alias("b"), F.col("runs").alias("runs_b")), "b").join(right, on)
    return joined.filter(alike("runs_a", "runs_b")).select("a", "b")


def _bins(sets: list[bytes]) -> np.ndarray:
    """How many runs of each set lie in each range of the hash."""
    return np.array([np.bincount(np.frombuffer(x, np.uint32) >> np.uint32(24), minlength=BINS) for x in sets], np.int32)


def _in_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between members that stand apart in a bucket and any others of it, among a block's rows."""
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    out: list[tuple[bytes, bytes]] = []
    if len(left) and len(right):
        band = int(rows.band.iloc[0])
        keys_l, keys_r = (np.stack(x.bands.to_list()) for x in (left, right))
        ids_l, ids_r, runs_l, runs_r = left.id.tolist(), right.id.tolist(), left.runs.tolist(), right.runs.tolist()
        bins_l, bins_r = _bins(runs_l), _bins(runs_r)
        sizes_l, sizes_r = bins_l.sum(axis=1), bins_r.sum(axis=1)
        apart = right.apart.tolist()
        label_l, label_r = left.label.tolist(), right.label.tolist()
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for i, a in enumerate(ids_l):
            # a pair that shares s of its n + m runs has a likeness of s / (n + m - s)
            most = np.minimum(bins_r, bins_l[i]).sum(axis=1)
            possible = (most >= LIKE * (sizes_l[i] + sizes_r - most) - 1e-6) & ~(keys_r[:, :band] == keys_l[i, :band]).any(axis=1)
            for j in np.flatnonzero(possible):
                # two that both stand apart meet twice; an earlier bucket's pairs and those linked already were left out
                if (apart[j] and ids_r[j] <= a) or (ra := root(label_l[i])) == (rb := root(label_r[j])):
                    continue
                if likeness(runs_l[i], runs_r[j]) >= LIKE:
                    parent[ra] = rb
                    out.append((a, ids_r[j]))
    return pd.DataFrame(out, columns=["a", "b"])


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text))


def _labelled_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, id, label) of each row: its text's key, and the smallest key of its class."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    keyed = scratch.stored(rows.select("doc_id", text_key(F.col("text")).alias("id")), "keys")
    # of equal texts one row is kept, without sending all of them to one task
    texts = scratch.stored_by(rows.select(text_key(F.col("text")).alias("id"), "text").dropDuplicates(["id"]), "texts", "id")
    signed = scratch.stored(texts.mapInArrow(_signed, "id binary, bands array<bigint>"), "signed")
    buckets = signed.select("id", F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = scratch.stored(joined_by(buckets, crowded, "key", "id"), "members")
    popular = members.groupBy("id").agg(F.sum("n").alias("popularity"))
    members = scratch.stored(members.join(popular, "id"), "members")
    hubs = members.groupBy("key").agg(F.max(F.struct("popularity", "id")).alias("hub")).select("key", F.col("hub.id").alias("hub"))
    members = scratch.stored(joined_by(members, hubs, "key", "id").select("id", "band", "key", "hub"), "members")
    pairs = scratch.stored(members.filter("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = scratch.stored(_verify(pairs, texts, scratch), "links")
    labels = components(links, scratch)
    rest = _apart(members, labels, scratch)
    if rest.head(1):
        blocks = _blocks(rest, members, labels, signed, texts, scratch)
        more = scratch.stored(blocks.groupBy("key", "i", "j").applyInPandas(_in_block, "a binary, b binary"), "links")
        if more.head(1):
            labels = components(links.union(more), scratch)
    return scratch.stored(joined_by(keyed, labels, "id", "doc_id", "left").withColumn("label", F.coalesce("label", "id")), "labelled")


def classes(docs: DataFrame) -> DataFrame:
    """docs' rows as (doc_id, class_id, class_key): near-duplicates share class_id, the smallest doc_id among them.

    class_key tells classes apart even where they share their smallest doc_id (an id that has unlike texts)
    or have none. Null and empty texts are equal to each other; texts without a word (white space) are
    alike only where they are equal. Repeated rows and equal doc_ids keep a row each; null ids get the class of
    their text, whose class_id is null only where no member has an id. Texts of fewer than five words are alike
    where their words are the same. Other columns are left out; an empty table gives an empty one.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = _labelled_rows(docs, scratch)
        smallest = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
        named = joined_by(rows, smallest, "label", "doc_id")
        return stored(named.select("doc_id", "class_id", F.lower(F.hex("label")).alias("class_key")), "classes")


def _apart(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Members outside their bucket's hub's class."""
    return scratch.stored(_with_labels(members, labels, scratch).filter("label <> hub_label").select("id", "band", "key", "label"), "apart")


def _with_labels(members: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """members with their label and their hub's."""
    named = scratch.stored(members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "named")
    of_hub = labels.select(F.col("id").alias("hub"), F.col("label").alias("hub_label"))
    return joined_by(named, of_hub, "hub", "id", "left").withColumn("hub_label", F.coalesce("hub_label", "hub"))


def _blocks(rest: DataFrame, members: DataFrame, labels: DataFrame, signed: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Buckets that hold members apart, dealt into blocks (i: of those apart, j: of all) of about BLOCK rows a side."""
    sizes = rest.groupBy("key").agg(F.count("*").alias("n_apart"))
    inside = scratch.stored(joined_by(members, sizes, "key", "id"), "inside")
    # a pair of two texts, one apart and the hub, was verified already; a bucket of two has nothing else
    full = inside.groupBy("key").agg(F.count("*").alias("n_all"), F.max("n_apart").alias("n_apart")).filter("n_all > 2")
    parts = full.select("key", F.ceil(F.col("n_apart") / BLOCK).cast("int").alias("n_i"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("n_j"))
    dealt = scratch.stored(joined_by(inside.filter("id <> hub"), parts, "key", "id").select("id", "band", "key", "hub", "n_i", "n_j"), "dealt")
    named = _with_labels(dealt, labels, scratch).withColumn("apart", F.col("label") != F.col("hub_label"))
    all_rows = scratch.stored(named.select("id", "band", "key", "label", "apart", "n_i", "n_j"), "blocks")
    wanted = all_rows.select("id").distinct()
    sets = scratch.stored(texts.join(wanted, "id").select("id", "text").mapInArrow(_as_bytes, "id binary, runs binary").join(signed, "id"), "runs")
    h = F.xxhash64("id", "key")
    left = all_rows.filter("apart").withColumn("i", F.pmod(h, "n_i").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1))).withColumn("side", F.lit(0))
    right = all_rows.withColumn("j", F.pmod(h, "n_j").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).withColumn("side", F.lit(1))
    columns = ("id", "band", "key", "label", "apart", "i", "j", "side")
    return left.select(*columns).union(right.select(*columns)).join(sets, "id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates: of each class one row stays, whole.

    That is the row of the smallest doc_id (null last); where this id has several rows in the class, the one
    whose text has the smallest key, and of rows equal in both, the first by their other columns (as JSON).
    An id that has texts of several classes stays once for each. Columns keep their names, whatever they are.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = _labelled_rows(docs, scratch).groupBy("label", "doc_id", "id").agg(F.count("*").alias("n"))
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "n"))
        keep = stored(rows.groupBy("label").agg(first.alias("kept")).select("kept.doc_id", "kept.id", "kept.n"), "keep")
    d, k = fresh(docs, "kept_doc", "kept_key")
    named = keep.select(F.col("doc_id").alias(d), F.col("id").alias(k))
    kept = docs.join(named, (text_key(whole_text()) == F.col(k)) & F.col("doc_id").eqNullSafe(F.col(d)), "left_semi")
    if not keep.filter("n > 1").head(1):
        return kept
    row = F.struct(*docs.columns)
    one = kept.groupBy(F.col("doc_id").alias(d), text_key(whole_text()).alias(k)).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return one.select("row.*")


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", "class_id")


#: All pairs that share a run, and reachability along links; for tables that fit one machine.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
runs AS (
  SELECT doc_id, run, row_number() OVER (PARTITION BY doc_id, run) AS k FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS run FROM words) r),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT s.a, s.b FROM shared s JOIN sizes x ON x.doc_id = s.a JOIN sizes y ON y.doc_id = s.b WHERE s.n::DOUBLE / (x.n + y.n - s.n) >= 0.8
  UNION SELECT a.doc_id, b.doc_id FROM words a JOIN words b ON a.text = b.text AND a.doc_id < b.doc_id),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT doc_id AS id, doc_id AS label FROM words UNION SELECT w.b, r.label FROM reached r JOIN ways w ON r.id = w.a)
SELECT id AS doc_id, min(label) AS class_id FROM reached GROUP BY id
"""
