"""Exact deduplication: the owner of every distinct text, found in Patricia tries.

Two texts are equal when they are the same after every run of white characters has become one space. Each task
inserts the bytes of its texts into a compressed radix trie, whose terminal nodes keep the smallest identifier
and count rows. A trie that outgrows its bound spills its largest subtree: the terminals below it go out and
their bytes are freed; a text that comes again begins anew, and the second round brings its terminals together.
So a text leaves a task about once, however many copies of it the task read.

The second round deals terminals by length and content hash, in that order within a task. A trie is spilled there, a
subtree after the other, where a length and hash end, since no equal text can follow.

Rows then find their owner by sha256 and length; the keys of large groups of copies are cut into pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, documents, fresh, joined_by, stored, whole_text

#: Bytes of labels that a task's trie holds before it spills.
MOST_BYTES = 48 << 20
#: Bytes of texts in a batch that leaves a task.
BATCH_BYTES = 8 << 20
_LAST = 1 << 63


class Node:
    """A run of bytes, the nodes that go on from it by their first byte, and the owner of the text that ends here."""

    __slots__ = ("label", "below", "owner", "rows", "ties")

    def __init__(self, label: bytes):
        self.label, self.below, self.owner, self.rows, self.ties = label, {}, None, 0, 0

    def add(self, owner: tuple[int, int], rows: int, ties: int) -> None:
        """owner: (identifier, tie); the smallest stays. ties: how many rows have just that one."""
        if self.owner is None or owner < self.owner:
            self.owner, self.ties = owner, 0
        self.rows += rows
        self.ties += ties if owner == self.owner else 0


def _shared(a: bytes, b: bytes) -> int:
    """How many bytes the beginnings have in common."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


class Trie:
    """A compressed radix trie of byte strings; held: the bytes of all labels."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, owner: tuple[int, int], rows: int = 1, ties: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            following = node.below.get(key[at])
            if following is None:
                following = node.below[key[at]] = Node(key[at:])
                self.held += len(key) - at
                node, at = following, len(key)
            elif key.startswith(following.label, at):
                node, at = following, at + len(following.label)
            else:
                shared = _shared(following.label, key[at : at + len(following.label)])
                upper = node.below[key[at]] = Node(following.label[:shared])
                following.label = following.label[shared:]
                upper.below[following.label[0]] = following
                node, at = upper, at + shared
        node.add(owner, rows, ties)

    def _terminals(self, node: Node, above: bytes) -> Iterator[tuple[bytes, Node]]:
        waiting = [(node, above)]
        while waiting:
            here, before = waiting.pop()
            text = before + here.label
            if here.owner is not None:
                yield text, here
            waiting += [(x, text) for x in here.below.values()]

    def _size(self, node: Node) -> int:
        total, waiting = 0, [node]
        while waiting:
            here = waiting.pop()
            total += len(here.label)
            waiting += here.below.values()
        return total

    def spill(self, least: int) -> Iterator[tuple[bytes, Node]]:
        """The terminals of the largest subtrees, until at most `least` bytes are held; each subtree goes as a whole.

        From the root down as long as one branch holds nearly everything, so what leaves is a part where that is possible.
        """
        while self.held > least:
            node, above = self.root, b""
            while True:
                sizes = {k: self._size(x) for k, x in node.below.items()}
                k = max(sizes, key=sizes.get)
                largest = node.below[k]
                if sizes[k] <= self.held - least or not largest.below:
                    break
                node, above = largest, above + largest.label
            del node.below[k]
            self.held -= sizes[k]
            yield from self._terminals(largest, above)

    def all(self) -> Iterator[tuple[bytes, Node]]:
        """All terminals; the trie is empty then."""
        root, self.root, self.held = self.root, Node(b""), 0
        return self._terminals(root, b"")


_TERMINAL = "length bigint, hash bigint, text binary, id bigint, tie bigint, rows bigint, ties bigint"
_OWNER = "text_sha256 string, length bigint, keep_id bigint, keep_tie bigint, group_size bigint, ties bigint"


def _batches(rows: Iterator[tuple[int, dict]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows: with the bytes that each is worth."""
    out, held = [], 0
    for size, row in rows:
        out.append(row)
        held += size + 100
        if held >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(out, kind)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.large_binary(), "string": pa.string()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    """Each text's bytes, one at a time."""
    for text in batch["text"]:
        yield text.as_buffer().to_pybytes()


def _first_round(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, dict]]:
            trie = Trie()
            for batch in batches:
                for i, tie, text in zip(batch["id"].to_pylist(), batch["tie"].to_pylist(), _texts(batch), strict=True):
                    trie.insert(text, (_LAST if i is None else i, tie))
                    if trie.held > most:
                        yield from map(_terminal, trie.spill(most // 2))
            yield from map(_terminal, trie.all())

        return _batches(rows(), _arrow(_TERMINAL))

    return run


def _terminal(found: tuple[bytes, Node]) -> tuple[int, dict]:
    text, node = found
    i, tie = node.owner
    hashed = xxhash.xxh3_64_intdigest(text) - (1 << 63)
    return len(text), {"length": len(text), "hash": hashed, "text": text, "id": None if i == _LAST else i, "tie": tie, "rows": node.rows, "ties": node.ties}


def _second_round(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, dict]]:
            trie, last = Trie(), None
            for batch in batches:
                for row, text in zip(batch.drop_columns(["text"]).to_pylist(), _texts(batch), strict=True):
                    here = (row["length"], row["hash"])
                    if trie.held > most and here != last:
                        yield from map(_owner, trie.spill(0))
                    last = here
                    trie.insert(text, (_LAST if row["id"] is None else row["id"], row["tie"]), row["rows"], row["ties"])
            yield from map(_owner, trie.all())

        return _batches(rows(), _arrow(_OWNER))

    return run


def _owner(found: tuple[bytes, Node]) -> tuple[int, dict]:
    text, node = found
    i, tie = node.owner
    return 100, {"text_sha256": hashlib.sha256(text).hexdigest(), "length": len(text), "keep_id": None if i == _LAST else i, "keep_tie": tie, "group_size": node.rows, "ties": node.ties}


def normalised(column: str = "text") -> Column:
    """The text with every run of white characters as one space; a missing one is empty."""
    return F.regexp_replace(whole_text(column), r"[\t-\r][\x20\t-\r]*|\x20[\x20\t-\r]+", " ")


def owners(docs: DataFrame, tie: Column | None = None, most: int = MOST_BYTES) -> DataFrame:
    """A row for each distinct text: sha256, length in bytes, its owner's doc_id and tie, the rows that have it,
    and how many of these have the owner's doc_id and tie.

    The owner has the smallest doc_id (null comes last), then the smallest tie (a bigint; none: 0). docs: doc_id, text
    and more. Null texts are empty texts; an empty table gives an empty one; a text of any length is compared
    whole. A task holds `most` bytes of texts and one text besides.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"), normalised().cast("binary").alias("text"))
    found = rows.mapInArrow(_first_round(most), _TERMINAL)
    dealt = found.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(_second_round(most), _OWNER)


def _rank(docs: DataFrame) -> Column:
    """Equal for rows that agree in all columns but those that have no hash, else very likely not."""
    return F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"])


def with_owners(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts one is kept: that with the smallest doc_id (rows without one come last, and keep_id is
    null where all are), among these the smallest hash of the whole row, among identical rows any one. Null
    counts as empty and belongs to the empty texts. Repeated rows stay as rows. Other columns are left out.
    """
    with Scratch(docs.sparkSession) as scratch:
        own = scratch.stored(owners(docs, _rank(docs)), "owners")
        text = normalised()
        digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _rank(docs).alias("tie"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
        # identical rows are one row until the end, however many there are
        counted = scratch.stored(digests.groupBy("doc_id", "tie", "text_sha256").agg(F.count("*").alias("n")), "digests")
        found = joined_by(counted, own, "text_sha256", "doc_id")
        is_owner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("tie") == F.col("keep_tie"))
        each = found.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        out = each.select("doc_id", "keep_id", "group_size", (is_owner & (F.col("k") == 1)).alias("kept"), "text_sha256")
        return stored(out, "op12")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns, whatever their names."""
    tie, sha, ties, i = fresh(docs, "tie", "sha", "ties", "keep_id")
    own = stored(owners(docs, _rank(docs)), "owners").select(F.col("text_sha256").alias(sha), F.col("keep_id").alias(i), F.col("keep_tie").alias(tie), F.col("ties").alias(ties))
    marked = docs.withColumns({sha: F.sha2(normalised().cast("binary"), 256), tie: _rank(docs)})
    # a row for each text at most, but for rows that are identical
    found = marked.join(own, [sha, tie]).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(i)))
    single, several = found.filter(F.col(ties) == 1), found.filter(F.col(ties) > 1).dropDuplicates([sha])
    return single.unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same by grouping the whole normalised texts.
SQL = """
WITH normal AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM normal"""


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_owners(documents(spark, sf_dir))
