"""Bounded training sample of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .common import held_out

# Most labelled documents that a classifier is fitted on.
SAMPLE = 6000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """``text, y`` of at most ``limit`` labelled documents, chosen by a hash of their ids, as a table.

    Held-out ids, null ids and null labels are left out; an id labelled twice counts with its larger label. Only the ids chosen, at most
    ``limit``, are sent to the executors. Nothing but text and label comes along.
    """
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
              .groupBy("doc_id").agg(F.max(label).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    chosen = durable(chosen)
    return durable(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("y").cast("int").alias("y")).limit(4 * limit))
