"""Document fingerprints: Merkle trees over sections and paragraphs.

A paragraph is a line; sections end at empty lines. A paragraph's digest is that of its text, a section's that of
its paragraphs' digests, the root that of the sections': roots are equal where texts are, and going down
where digests differ, first among sections and then among the paragraphs of those that differ, leads to the edit.

For likeness a paragraph has leaves, short runs of words that end where a word's own hash says so, so an edit
changes the leaves that it touches and no others.

A fingerprint is "root.sections.paragraphs.leaves": the root in hex; per section how many paragraphs it has
and its digest; per paragraph how many leaves it has and its digest; and three bytes of every leaf. Likeness is
the part of the leaves, by number, that two fingerprints share (1 for equal roots).

A document's neighbour comes without a window over the whole table: doc_ids are cut at quantiles into
ranges (rows without an id by a hash of their text), and each range's first document is also sent to the range before it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, whole_text

#: A word ends a leaf with a probability of 1/LEAF.
LEAF = 4
RANGES_A_PARTITION = 4
_MULTIPLY, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _leaves(words: list[str]) -> np.ndarray:
    """A digest of each run of words; the words' order counts."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    ends = (h >> np.uint64(32)) % np.uint64(LEAF) == 0
    starts = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(starts, np.diff(np.append(starts, len(h)))).astype(np.uint64)
    mixed = (h ^ (place * _PLACE)) * _MULTIPLY
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)


#: Bytes of a digest that a fingerprint keeps for a section and for a paragraph.
_SHORT = 8
_NODE = np.dtype([("n", "<u4"), ("digest", f"V{_SHORT}")])


def fingerprint(text: str) -> str:
    """Equal texts have equal fingerprints; a single changed character changes the root."""
    root, section, n = hashlib.sha256(), hashlib.sha256(), 0
    sections, paragraphs, leaves = [], [], []

    def close() -> None:
        digest = section.digest()
        root.update(digest)
        sections.append(n.to_bytes(4, "little") + digest[:_SHORT])

    for line in text.split("\n"):
        if not line:
            close()
            section, n = hashlib.sha256(), 0
            continue
        own = _leaves(line.split(" "))
        digest = hashlib.sha256(line.encode()).digest()
        section.update(digest)
        n += 1
        paragraphs.append(len(own).to_bytes(4, "little") + digest[:_SHORT])
        leaves.append(own)
    close()
    short = np.concatenate(leaves).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5:].tobytes() if leaves else b""
    return ".".join((root.hexdigest(), *(base64.b64encode(x).decode() for x in (b"".join(sections), b"".join(paragraphs), short))))


def _nodes(part: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(part), _NODE)


def _leaves_of(fp: str) -> np.ndarray:
    three = np.frombuffer(base64.b64decode(fp.rpartition(".")[2]), np.uint8).reshape(-1, 3).astype(np.uint32)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16


def likeness(a: str, b: str) -> float:
    """Twice the shared leaves (as multisets) over all leaves; 1 for equal roots, 0 if either has none else."""
    if a.partition(".")[0] == b.partition(".")[0]:
        return 1.0
    x, y = _leaves_of(a), _leaves_of(b)
    if not len(x) or not len(y):
        return 0.0
    (u, n), (v, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(n[i], m[j]).sum() / (len(x) + len(y)))


def _differing(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Where two lists of digests differ: from and to in a, from and to in b."""
    found = SequenceMatcher(None, a["digest"].tolist(), b["digest"].tolist(), autojunk=False)
    return [(i, j, k, m) for step, i, j, k, m in found.get_opcodes() if step != "equal"]


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where the trees differ: paragraphs from and to in a, from and to in b (numbered from 0; "to" isn't in it).

    Equal roots end the search; else sections are compared, and paragraphs only within sections that differ. What
    is put in has an empty range in a, what is taken out one in b, what is moved is both. Where sections
    differ and all of their paragraphs are equal, empty lines differ, and the range is empty on both sides.
    """
    if a.partition(".")[0] == b.partition(".")[0]:
        return []
    (_, x, p, _), (_, y, q, _) = a.split("."), b.split(".")
    x, y, p, q = _nodes(x), _nodes(y), _nodes(p), _nodes(q)
    at_x, at_y = ([0, *np.cumsum(s["n"], dtype=np.int64).tolist()] for s in (x, y))
    out = []
    for i, j, k, m in _differing(x, y):
        i, j, k, m = at_x[i], at_x[j], at_y[k], at_y[m]
        inner = _differing(p[i:j], q[k:m])
        out += [(i + u, i + v, k + s, k + t) for u, v, s, t in inner] or [(i, i, k, k)]
    return out


def with_fingerprints(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `fingerprint`, which replaces a column of that name; a null text counts as empty.

    Rows are worked on one by one, whatever their length: repeated rows stay, an empty table gives an empty one.
    """

    @F.pandas_udf("string")
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(fingerprint)

    return docs.withColumn("fingerprint", prints(whole_text(column)))


def _bounds(ids: DataFrame, n: int) -> list[int]:
    """Lower bounds of at most n ranges of doc_id with about as many rows."""
    found = ids.filter("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(n)], 0.25 / n)
    return sorted({int(x) for x in found})


def _numbered(rows: DataFrame, bounds: list[int], n_null: int) -> DataFrame:
    """rows with `range`, in the order of descending doc_id; those without come last, by equal parts of their ties."""
    edges = np.array(bounds[1:], np.int64)
    last = len(bounds) - 1

    @F.pandas_udf("int")
    def of_id(ids: pd.Series) -> pd.Series:
        return pd.Series(last - np.searchsorted(edges, ids.to_numpy(np.int64), side="right").astype(np.int32), index=ids.index)

    share = (F.col("tie").cast("double") + 2.0**63) / 2.0**64
    of_null = len(bounds) + F.least(F.floor(share * n_null), F.lit(n_null - 1)).cast("int")
    return rows.withColumn("range", F.when(F.col("doc_id").isNull(), of_null).otherwise(of_id(F.coalesce("doc_id", F.lit(0).cast("long")))))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows, guests behind its own, descending: pairs each own row with the row behind it."""
    held, out = None, []
    for batch in batches:
        for r, guest, doc_id, text in zip(*(batch[c].to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True):
            here = (r, guest, doc_id, text, fingerprint(text))
            if held and held[0] == r and not held[1]:
                out.append(_row(held, here))
            held = here
        if out:
            yield pa.RecordBatch.from_pylist(out)
            out = []


def _row(this: tuple, following: tuple) -> dict:
    text, third = this[3], len(this[3]) // 3
    edited = text[: len(text) - third] + following[3][:third]
    fp = fingerprint(edited)
    return {
        "doc_id": this[2], "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(), "fingerprint": this[4], "edited_fingerprint": fp,
        "near_edited": likeness(this[4], fp), "near_next": likeness(this[4], following[4]),
    }


def compared(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like it the edited and the next text are.

    Edited: the last third of the code points (rounded down) replaced by the first as many, or all there
    are, of the next document in descending doc_id; null ids come last, rows of equal doc_id go by a hash
    of the text, and behind the last document comes the first. A lone document is its own next. A null
    text is empty; an empty table gives an empty one; other columns are left out. Texts are read whole, two at a time.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("tie", F.xxhash64("text"))
    spark = docs.sparkSession
    n = RANGES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_null, n_all = rows.agg(F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    null_ranges = max(1, n * n_null // max(1, n_all))
    placed = _numbered(rows, _bounds(rows.select("doc_id"), n), null_ranges)
    # the first row of each range: a row for each of at most n + null_ranges ranges
    firsts = placed.groupBy("range").agg(F.max("doc_id").alias("id"), F.min("tie").alias("tie")).orderBy("range").collect()
    before = {r.range: firsts[i - 1].range for i, r in enumerate(firsts)}
    by_range = {r.range: r for r in firsts}
    count = max(by_range, default=0) + 1
    at = (F.col("range") + 1).cast("int")
    look_up = lambda values, kind: F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at)
    first_id = look_up([by_range[i].id if i in by_range else None for i in range(count)], "bigint")
    first_tie = look_up([by_range[i].tie if i in by_range else None for i in range(count)], "bigint")
    is_first = F.when(F.col("doc_id").isNull(), F.col("tie") == first_tie).otherwise(F.col("doc_id") == first_id)
    visited = look_up([before.get(i) for i in range(count)], "int")
    visits = F.array(F.struct("range", F.lit(0).alias("guest")), F.when(is_first, F.struct(visited.alias("range"), F.lit(1).alias("guest"))))
    sent = placed.withColumn("v", F.explode(F.array_compact(visits))).select("v.range", "v.guest", "doc_id", "text", "tie")
    # a range is a partition, so neighbours in number needn't share one
    dealt = sent.repartitionById(count, F.col("range")).sortWithinPartitions("guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(_neighbours, _OUT)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
