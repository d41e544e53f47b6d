"""Whitening of embeddings by principal components.

Each partition takes the count, the mean and the centred scatter of its vectors; states are merged in pairs by Chan's
formula in a tree, so neither a task nor the driver holds more than a few states, whose size is that of a matrix of the
dimensions. The driver finds the eigenvectors of the one covariance that is left. A second pass projects the
vectors, and a third takes the covariance of what came out by the same merging, which must be the identity.

Entries are whole numbers, so counts and sums are exact: means are rounded once, and deviations not at all.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: How entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: An eigenvalue of less than this part of the largest one is no variance but rounding.
LEAST_PART = 1e-12
#: States that are merged at a time.
FAN_IN = 8
#: Above this, sums of int64 might overflow.
_SAFE = 2.0**62
_LIMIT = 2.0**62


@dataclass
class State:
    """n vectors, their exact sums (Python's integers, so never too large), and the scatter around their mean."""

    n: int
    sums: list[int]
    scatter: np.ndarray


def of_rows(x: np.ndarray) -> State:
    """x: whole numbers, a row for each vector, one row or more."""
    n = len(x)
    safe = float(np.abs(x).max(initial=0)) * n < _SAFE
    sums = [int(s) for s in (x if safe else x.astype(object)).sum(axis=0)]
    around = _less(x, sums, n)
    return State(n, sums, around.T @ around)


def _less(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - sums / n, rounded once where that can be done in int64."""
    if float(np.abs(x).max(initial=0)) * n + max(map(abs, sums), default=0) < _SAFE:
        return (x * n - np.array(sums, np.int64)) / float(n)
    return x.astype(float) - np.array([s / n for s in sums])


def merged(a: State | None, b: State | None) -> State | None:
    """Chan's formula: the scatters, and what the distance between the means adds."""
    if a is None or b is None:
        return a or b
    apart = np.array([float(t * a.n - s * b.n) for s, t in zip(a.sums, b.sums, strict=True)]) / (float(a.n) * b.n)
    return State(a.n + b.n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], a.scatter + b.scatter + np.outer(apart, apart) * (a.n / (a.n + b.n) * b.n))


@dataclass
class Spread:
    """The same of doubles, with their mean."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray


def spread_merged(a: Spread | None, b: Spread | None) -> Spread | None:
    if a is None or b is None:
        return a or b
    n, apart = a.n + b.n, b.mean - a.mean
    return Spread(n, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n / n * b.n))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as long; beyond 2^62 the nearest of those."""
    return np.clip(np.floor(values * SCALE), -_LIMIT, _LIMIT).astype(np.int64) + SHIFT


def _vectors(batch: pa.RecordBatch, d: int) -> tuple[pa.Array, np.ndarray]:
    """(vec_id, entries as whole numbers) of the rows that remain."""
    lists = batch["embedding"]
    usable = pc.fill_null(pc.equal(pc.list_value_length(lists), d), False)
    ids, lists = batch["vec_id"].filter(usable), lists.filter(usable)
    flat = lists.flatten()
    values = np.array(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(lists), d)
    finite = np.isfinite(values).all(axis=1)
    return ids.filter(pa.array(finite)), whole(values[finite])


def _tree(states: DataFrame, merge) -> State | Spread | None:
    """All states as one, merged FAN_IN at a time on the executors. states: a column of pickled ones."""
    rdd = states.rdd.map(lambda r: pickle.loads(r[0]))
    depth = max(2, math.ceil(math.log(max(1, rdd.getNumPartitions()), FAN_IN)))
    # None stands for a partition without vectors
    return rdd.mapPartitions(lambda found: [reduce(merge, found, None)]).treeReduce(merge, depth)


def _pickled(found: State | Spread | None) -> Iterator[pa.RecordBatch]:
    if found is not None:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["state"])


def fitted(vectors: DataFrame, d: int) -> State | None:
    """The state of all vectors of d finite entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (of_rows(x) for _, x in (_vectors(b, d) for b in batches) if len(x))
        return _pickled(reduce(merged, own, None))

    return _tree(vectors.select("vec_id", "embedding").mapInArrow(run, "state binary"), merged)


@dataclass
class Components:
    """Unit eigenvectors as columns, by falling eigenvalue, each with its largest entry positive; of the noise none."""

    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def components(state: State, most: int = COMPONENTS) -> Components:
    covariance = state.scatter / state.n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(covariance))
    values = np.where(values > LEAST_PART * max(values.max(initial=0), 0), values, 0.0) if trace > 0 else np.zeros(len(order))
    return Components(vectors, values, values / trace if trace > 0 else values)


def deviations(x: np.ndarray, state: State) -> list[int | None]:
    """Per row the exact sum of (n * x - S)^2; None where it exceeds a long."""
    furthest = float(np.abs(x).max(initial=0)) * state.n + max(map(abs, state.sums), default=0)
    if furthest < _SAFE:
        apart = x * state.n - np.array(state.sums, np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * max(1, x.shape[1]) < _SAFE:
            return (apart * apart).sum(axis=1).tolist()
        apart = apart.astype(object)
    else:
        apart = x.astype(object) * state.n - np.array(state.sums, object)
    found = (apart * apart).sum(axis=1).tolist()
    return [s if s < 1 << 63 else None for s in found]


def _dimensions(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, the longer of two; 0 without any."""
    found = vectors.filter("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    first = found.filter("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    return first.d if first else 0


_ROW = "vec_id bigint, deviation bigint, whitened array<double>"
_OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    vectors: vec_id and embedding, an array of numbers; other columns are left out. Rows whose vector is null or has null or
    infinite entries or NaN go, and, where lengths differ, those that haven't the most frequent length (the longer of two). Rows
    that repeat an id or a vector, or have no id, count and stay like any other. An empty table gives an empty
    one. A component without variance (of equal vectors, or in fewer vectors than dimensions) has whitened and
    explained 0 and doesn't count for identity_error. Eigenvectors of equal eigenvalues are any of those possible.
    A deviation beyond a long is null; an entry beyond 2^62 counts as that.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    d = _dimensions(vectors)
    state = fitted(vectors, d) if d else None
    if state is None:
        return spark.createDataFrame([], _OUT)
    found = components(state, most)
    has = found.values > 0
    basis = np.where(has, found.vectors / np.sqrt(np.where(has, found.values, 1.0)), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _vectors(batch, d)
            z = _less(x, state.sums, state.n) @ basis
            lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, basis.shape[1], dtype=np.int32), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(x, state), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    rows = stored(vectors.mapInArrow(project, _ROW), "whitened")
    error = identity_error(rows, has)
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(v)) for v in found.explained]), F.col("i") + 1)
    return each.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(state.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).cast("double").alias("identity_error")
    )


def identity_error(rows: DataFrame, has: np.ndarray) -> float:
    """How far the covariance of the column `whitened` is from the identity, over the components that have variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def own() -> Iterator[Spread]:
            for batch in batches:
                if batch.num_rows:
                    z = batch["whitened"].flatten().to_numpy().reshape(batch.num_rows, -1)
                    mean = z.mean(axis=0)
                    yield Spread(len(z), mean, (z - mean).T @ (z - mean))

        return _pickled(reduce(spread_merged, own(), None))

    total = _tree(rows.select("whitened").mapInArrow(run, "state binary"), spread_merged)
    off = np.abs(total.scatter / total.n - np.eye(len(has)))[np.ix_(has, has)]
    return float(off.max(initial=0.0))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
