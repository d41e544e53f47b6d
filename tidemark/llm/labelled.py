"""Bounded samples of labelled rows for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo `of`; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % of


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, column) without nulls; of an id's labels that disagree, the smallest."""
    known = labels.select("doc_id", column).filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy("doc_id").agg(F.min(column).alias(column))


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows, those that come first by a seeded hash of doc_id, which is distinct."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)


def with_texts(ids: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """ids with their texts; ids is a sample of bounded size, so it is broadcast. Of repeated ids the smallest text is kept."""
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min("text").alias("text"))
