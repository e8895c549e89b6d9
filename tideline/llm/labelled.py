"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import bounded, held_out


def training_labels(labels: DataFrame, label: str, most: int, parts: int | None = None, remainder: int = 0) -> DataFrame:
    """(doc_id, label) of at most ``most`` documents that training may see.

    Null ids and null labels are left out; a document with several labels has the
    largest. The sample is the ids that hash lowest, so it doesn't depend on how
    the table is laid out.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if parts is not None:
        rows = rows.where(~held_out("doc_id", parts, remainder))
    return bounded(rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")), "doc_id", most)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, text, label), one row for each sampled id that has a document; the sample's size is bounded by its caller.

    Of several texts under one id the smallest counts: a minimum is combined before
    the shuffle, so an id that very many rows have is neither a hot key nor collected.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
