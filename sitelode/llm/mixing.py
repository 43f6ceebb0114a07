"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w`` with ``u`` from its id and ``w`` from its quality. Within a source, ascending
keys are a weighted sample without replacement, so a prefix of a source in key order whose sizes reach the budget is the
fractional epoch. No source is sorted as a whole: sizes are summed per key bucket before the shuffle, the running
sum over buckets names the one bucket in which the budget ends, and only that bucket's documents are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .common import GAP, null_key, words_between

# Slices of the key range, of equal probability for documents of LEAST_WEIGHT; of weight 1 a slice holds at most 1 / LEAST_WEIGHT times as many. So
# the one slice of a source that is ordered holds less than a thousandth of it, whatever its weights are.
BUCKETS = 16384
LEAST_WEIGHT = 0.1


def quality_weight(text: Column, size: Column) -> Column:
    """Between :data:`LEAST_WEIGHT` and 1: falls as the mean characters per word, white space included, leave the 6 of running text;
    the least for texts without words."""
    least = F.lit(LEAST_WEIGHT)
    return F.when(size > 0, F.greatest(least, 1 - F.abs(F.length(text).cast("double") / size - 6) / 10)).otherwise(least)


def source_targets(sources: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """``target`` per source from ``source`` and ``source_size``: shares by weight, no share above
    ``max_epochs`` sizes, the excess shared again by weight.

    The final level is found directly: in ascending order of cap / weight, a source is capped while the level that
    the remaining budget gives is at least its cap / weight. One row per source, so plain windows are small.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    named = sources.withColumn("_w", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    named = named.withColumn("_cap", max_epochs * F.col("source_size").cast("double"))
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    # A source is free once its cap lies above the level; the first free one's level holds for all after it.
    leveled = named.withColumn("_level", level).withColumn("_free", F.col("_cap") > F.col("_level") * F.col("_w"))
    final = F.max(F.when(F.col("_free"), F.struct(-F.col("_cap") / F.col("_w"), F.col("_level")))).over(whole)["_level"]
    return (leveled.withColumn("_final", final)
            .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_final") * F.col("_w")), F.col("_cap")))
            .select("source", "source_size", "target"))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, buckets: int = BUCKETS,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Words that the mix takes of each document.

    ``docs`` needs ``doc_id, text, source``; ``keep`` names more columns to return (names of the result win over
    them). Returns ``doc_id, size, source_size, target, taken`` and ``keep``, one row per input row. ``taken`` is
    ``size`` times the complete epochs of the source, plus ``size`` if the document is in the fractional epoch. A
    document whose middle lies within the budget is taken, so a source misses its target by half a document at most.
    A null text has size 0, a null source is a source of its own, named last; equal keys go by id and size, and rows equal
    in both are interchangeable. Empty tables give no rows.
    """
    made = {"doc_id", "size", "source_size", "target", "taken"}
    keep = tuple(c for c in keep if c not in made)
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    uniform = (digits.cast("double") + 0.5) / float(1 << 52)
    counted = docs.withColumn("__words", F.size(words_between(F.col("text"), GAP)).cast("long"))
    sized = durable(counted.select(
        F.col("doc_id"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("_kept"),
        F.col("source").alias("_source"), null_key("source").alias("_group"),
        F.col("__words").alias("size"),
        (-F.log(uniform) / quality_weight(F.col("text"), F.col("__words"))).alias("_key"),
    ).withColumn("_bucket", F.floor((1 - F.exp(-LEAST_WEIGHT * F.col("_key"))) * buckets).cast("long")))

    hist = sized.groupBy("_group", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_source").alias("source"))
    hist = durable(hist)
    totals = hist.groupBy("_group").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    plan = (source_targets(totals.select("source", "source_size"), weights, max_epochs)
            .withColumn("_group", null_key("source")).drop("source")
            .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(F.lit(0)).cast("long"))
            .withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")))
    running = F.sum("_sum").over(Window.partitionBy("_group").orderBy("_bucket"))
    ends = (hist.withColumn("_to", running).join(plan.select("_group", "_rest"), "_group")
            .filter((F.col("_to") - F.col("_sum") < F.col("_rest")) & (F.col("_rest") < F.col("_to")))
            .select("_group", F.col("_bucket").alias("_end"), (F.col("_to") - F.col("_sum")).alias("_base")))
    # A budget that ends between two buckets has no bucket of its own: the last full one is its end.
    full = (hist.withColumn("_to", running).join(plan.select("_group", "_rest"), "_group")
            .filter(F.col("_to") <= F.col("_rest")).groupBy("_group").agg(F.max("_bucket").alias("_full")))
    cut = durable(plan.join(ends, "_group", "left").join(full, "_group", "left"))

    rows = sized.join(cut, "_group")
    inside = F.col("_bucket") <= F.coalesce(F.col("_full"), F.lit(-1))
    at_end = F.coalesce(F.col("_bucket") == F.col("_end"), F.lit(False))
    order = Window.partitionBy("_group").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = (rows.filter(at_end)
            .withColumn("_before", F.col("_base") + F.coalesce(F.sum("size").over(order), F.lit(0)))
            .withColumn("_pick", 2 * F.col("_before") + F.col("size") <= 2 * F.col("_rest")).drop("_before"))
    picked = rows.filter(~at_end).withColumn("_pick", inside).unionByName(edge)
    return picked.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * (F.col("_epochs") + F.col("_pick").cast("long"))).alias("taken"),
        *[F.col("_kept").getField(f"c{i}").alias(c) for i, c in enumerate(keep)])
