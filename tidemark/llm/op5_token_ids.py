"""Token ids in binary segments of directly addressable codes.

An id is cut into chunks of 8 bits, lowest first. Level 0 holds every id's first chunk, level 1 the next
chunk of those that have one, and so on; a bitmap at each level says which go on, and a directory of ones
before each block of 512 bits turns a place at one level into the place at the next. So any id is read by
a few look-ups, without decoding what stands around it.

Documents go to range partitions by doc_id, are sorted there, tokenized and written by Spark as rows of
segments of at most SEGMENT ids; a document of more ids has segments of its own, all others lie in one. Pages
aren't compressed, so that a code can be read where it lies. A segment is complete in itself and knows how many
ids its partition has before it; how many the partitions before have is a sum over a row for each of them. A
position's segment is found by an equi-join on blocks of SEGMENT positions, and token_at reads its id from there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, run_dir, whole_text

MODEL = "word_bpe_49k.json"
END = 1
BITS = 8
BLOCK = 512
#: A segment holds at most so many ids.
SEGMENT = 1 << 18
#: So many words' ids are kept by a Python worker; beyond, they are encoded whenever they are needed.
MOST_WORDS = 1_000_000
LONGEST_KEPT = 48

_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_loaded: dict = {}


# ---- the code ----


def pack(ids: np.ndarray) -> bytes:
    """One segment: "DAC1", ids, levels; for each level its length, directory, bitmap and chunks."""
    rest, levels = np.asarray(ids, np.uint32), []
    while True:
        more = rest >> BITS > 0
        ones = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK)))]) if len(more) else np.zeros(1)
        levels.append(struct.pack("<Q", len(rest)) + ones.astype("<u4").tobytes() + np.packbits(more, bitorder="little").tobytes() + (rest & (1 << BITS) - 1).astype(np.uint8).tobytes())
        if not more.any():
            return struct.pack("<4sQB", b"DAC1", len(ids), len(levels)) + b"".join(levels)
        rest = rest[more] >> BITS


class Segment:
    """Reads a packed segment; segment[i] is its i-th id."""

    def __init__(self, data: bytes):
        magic, self.n, n_levels = struct.unpack_from("<4sQB", data)
        if magic != b"DAC1":
            raise ValueError("not a segment")
        at, self.levels = 13, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            blocks = -(-n // BLOCK) + 1
            ones = np.frombuffer(data, "<u4", blocks, at := at + 8)
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at := at + 4 * blocks)
            chunks = np.frombuffer(data, np.uint8, n, at := at + len(bits))
            at += n
            self.levels.append((n, ones, bits, chunks))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for _, ones, bits, chunks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK * (BLOCK // 8)
            before = bits[block : i >> 3]
            i = int(ones[i // BLOCK]) + int(np.bitwise_count(before).sum()) + int(bits[i >> 3] & (1 << (i & 7)) - 1).bit_count()
            shift += BITS
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level from the last."""
        value = np.zeros(0, np.uint32)
        for n, _, bits, chunks in reversed(self.levels):
            here = chunks.astype(np.uint32)
            if len(value):
                here[np.unpackbits(bits, count=n, bitorder="little").view(bool)] |= value << BITS
            value = here
        return value


# ---- the tokenizer ----


def _folded(text: str) -> str:
    """Lower case, where that is the same as the tokenizer's own: Latin letters, and no special token's string."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class _Words:
    """The ids of texts, word by word: this tokenizer parts texts at white space, then lowers case, before all else."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kept = {"": b""}
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> bytes:
        words, kept = _folded(text).replace("\n", " ").split(" "), self.kept
        try:
            return b"".join(map(kept.__getitem__, words))
        except KeyError:
            codes = self._codes({w for w in words if w not in kept})
        return b"".join([kept[w] if w in kept else codes[w] for w in words])

    def _codes(self, new: set[str]) -> dict[str, bytes]:
        """The ids of words that aren't kept; they are, from now on, while there is room.

        Letters and punctuation behind them are parted by the tokenizer itself, so each is encoded once.
        """
        kept, codes = self.kept, {}
        parts = {w: w.rstrip(_MARKS) for w in new}
        # the tokenizer lowers case first: a letter whose lower case ends in a combining mark isn't parted from what follows
        bases = {b for w, b in parts.items() if len(b) < len(w) and b.isalpha() and (b.isascii() or b[-1].lower()[-1].isalpha())}
        tails = {w[len(b) :] for w, b in parts.items() if b in bases}
        whole = {w for w, b in parts.items() if b not in bases or b == w}
        wanted = [w for w in whole | bases | tails if w not in kept]
        codes |= self._letters([w for w in wanted if w.isalpha() and (w.isascii() or w.lower().isalpha())])
        rest = [w for w in wanted if w not in codes]
        codes |= {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True)}
        if len(kept) < MOST_WORDS:
            kept.update((w, c) for w, c in codes.items() if len(w) <= LONGEST_KEPT)
        get = lambda w: codes[w] if w in codes else kept[w]
        return {w: get(b) + get(w[len(b) :]) if b in bases and b != w else get(w) for w, b in parts.items()}

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone, as one text: each ends with a token that says so."""
        if not words:
            return {}
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(ends) != len(words):  # a letter that becomes more than a letter in lower case
            return {}
        data, at = ids.tobytes(), [0, *ends.tolist()]
        return {w: data[a:b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)}


def _words(path: str) -> _Words:
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[path] = _Words(path)
    return _loaded[path]


_SEGMENTS = "part int, seq int, inside bigint, n_ids bigint, doc_at bigint, doc_ids array<bigint>, n_tokens array<bigint>, data binary"
_ARROW = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("inside", pa.int64()), ("n_ids", pa.int64()), ("doc_at", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())]
)


def _segments(path: str, end: int | None, most: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, seq, inside = _words(path), TaskContext.get().partitionId(), 0, 0
        close = b"" if end is None else struct.pack("<I", end)
        doc_ids, lengths, held, size = [], [], [], 0

        def segment(ids: bytes, docs: list, n_tokens: list, doc_at: int | None = None) -> pa.RecordBatch:
            nonlocal seq, inside
            row = {"part": part, "seq": seq, "inside": inside, "n_ids": len(ids) // 4, "doc_at": doc_at, "doc_ids": docs, "n_tokens": n_tokens, "data": pack(np.frombuffer(ids, "<u4"))}
            seq, inside = seq + 1, inside + len(ids) // 4
            return pa.RecordBatch.from_pylist([row], _ARROW)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = words.encode(text) + close
                n = len(ids) // 4
                if doc_ids and size + n > most:
                    yield segment(b"".join(held), doc_ids, lengths)
                    doc_ids, lengths, held, size = [], [], [], 0
                if n > most:  # a piece to a segment; each says how many ids the document has
                    for at in range(0, n, most):
                        yield segment(ids[4 * at : 4 * (at + most)], [doc_id], [n], at)
                    continue
                doc_ids.append(doc_id)
                lengths.append(n)
                held.append(ids)
                size += n
        if doc_ids:
            yield segment(b"".join(held), doc_ids, lengths)

    return make


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, most: int = SEGMENT) -> None:
    """Tokenizes whole texts and writes them at path in ascending doc_id order, null first, equal ids by text.

    The tokenizer must part texts at white space. A null text is empty: its ids are the end id alone. A
    repeated row is written as often as it stands there, a text of any length whole. An empty table gives a readable
    table without rows. Other columns are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_segments(tokenizer, end, most), _SEGMENTS).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The segments at path with `start`, the ids before each."""
    segments = spark.read.schema(_SEGMENTS).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition that was written, so as many as that shuffle had partitions
    return segments.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("inside"))


def token_at(segments: DataFrame, positions: DataFrame, block: int = SEGMENT) -> DataFrame:
    """positions(position) with the id that stands there in segments, as read_ids gives them; null outside of all ids.

    block: a power of ten or two near the segments' size. Positions may repeat and be null.
    """
    at = F.floor(F.col("position") / block)
    spans = segments.filter("n_ids > 0").select("start", "n_ids", "data", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_ids") - 1) / block))).alias("block"))
    wanted = positions.select("position").distinct().withColumn("block", at)
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_ids"))
    # a segment's code goes once to all positions that lie in it
    by_segment = wanted.join(spans.drop("data"), "block").filter(inside).groupBy("start").agg(F.collect_list("position").alias("positions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data, found in zip(*(batch[c].to_pylist() for c in ("start", "data", "positions")), strict=True):
                code = Segment(data)
                yield pa.RecordBatch.from_pydict({"position": pa.array(found, pa.int64()), "id": pa.array([code[x - start] for x in found], pa.int64())})

    ids = by_segment.join(segments.select("start", "data"), "start").mapInArrow(read, "position bigint, id bigint")
    return positions.join(ids, "position", "left")


_DIGEST = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, middle_id bigint"


def _read_through(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, Segment]]:
    for batch in batches:
        for row in batch.to_pylist():
            code = Segment(row["data"])
            yield row, code.all().astype("<u4", copy=False), code


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, ids, code in _read_through(batches):
        ends = np.cumsum(row["n_tokens"], dtype=np.int64)
        starts = ends - np.array(row["n_tokens"], np.int64)
        crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        middles = [code[m] if b > a else None for a, b in zip(starts.tolist(), ends.tolist(), strict=True) for m in ((a + b) // 2,)]
        columns = {"doc_id": row["doc_ids"], "start": starts + row["start"], "n_tokens": row["n_tokens"], "ids_crc32": crcs, "middle_id": middles}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a long document's segments: where the document starts, and the piece's own digest."""
    for row, ids, code in _read_through(batches):
        (n,), at = row["n_tokens"], row["doc_at"]
        middle = code[n // 2 - at] if 0 <= n // 2 - at < len(ids) else None
        columns = {"doc_id": row["doc_ids"], "start": [row["start"] - at], "n_tokens": [n], "at": [at], "bytes": [4 * len(ids)], "crc": [zlib.crc32(ids)], "middle_id": [middle]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def joined_crc(crcs: list[int], lengths: list[int]) -> int:
    """The crc32 of pieces put together, from each one's own and its length in bytes.

    A piece behind a start value gives what it gives behind none, changed by what zeros make of that value.
    """
    total = 0
    for crc, n in zip(crcs, lengths, strict=True):
        zeros = b"\0" * n
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def digest(segments: DataFrame) -> DataFrame:
    """Per document, from the segments: where it starts, how many ids it has, their crc32, and the id in its middle.

    The middle one, at n_tokens // 2, is read by itself, without decoding what stands around it.
    """
    whole = segments.filter("doc_at is null").mapInArrow(_digest, _DIGEST)
    pieces = segments.filter("doc_at is not null").mapInArrow(_pieces, "doc_id bigint, start bigint, n_tokens bigint, at bigint, bytes bigint, crc bigint, middle_id bigint")

    @F.pandas_udf("long")
    def crc(rows: pd.Series) -> pd.Series:
        return rows.map(lambda found: joined_crc([x["crc"] for x in found], [x["bytes"] for x in found]))

    # a row for each segment of a document
    long = pieces.groupBy("start").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.max("middle_id").alias("middle_id"), F.sort_array(F.collect_list(F.struct("at", "bytes", "crc"))).alias("rows"))
    return whole.union(long.select("doc_id", "start", "n_tokens", crc("rows").alias("ids_crc32"), "middle_id"))


def written_and_read(docs: DataFrame, name: str = "ids", most: int = SEGMENT) -> DataFrame:
    """The digest of docs once written into the shared folder and read back."""
    import uuid

    import public_tokenizers

    path = f"{run_dir(docs.sparkSession)}/{name}-{uuid.uuid4().hex}"
    write_ids(docs, path, public_tokenizers.path(MODEL), most=most)
    return digest(read_ids(docs.sparkSession, path))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_and_read(documents(spark, sf_dir))
