"""Ranking inside groups that stays distributed when one group holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

# Spark prunes ``row_number() <= n`` before the shuffle up to this n (windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Rows that one task ranks, and characters of text in them: what it sorts fits its memory.
RANGE_ROWS = 1_000_000
RANGE_CHARS = 32_000_000
# Characters from which a range of its own pays, while there are fewer ranges than cores.
LEAST_CHARS = 1_000_000
# Most rows of a table of sizes that every task gets.
SENT_ROWS = 100_000


def _key(order: Sequence) -> list[Column]:
    return [o if isinstance(o, Column) else F.col(o) for o in order]


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence, name: str = "idx",
              range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exact 1-based position of each row in its group, ascending by ``order`` (must be unique), as a long.

    Rows are dealt once, to ranges over (group, order), sorted there and written with their numbers; so rows of a group lie together in the
    result. The number of ranges follows from the rows and the length of their texts, so a task sorts what fits it however large a group is. A
    position is the number within the range, from the first row of the group on, plus the sizes of the group's ranges before it. The input is read for
    its size, for the borders of the ranges and for its rows: give a table where it is dear.
    """
    by = list(by)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_key(order))])
    texts = [F.coalesce(F.length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() == "string"]
    rows, chars = df.agg(F.count(F.lit(1)), F.sum(reduce(Column.__add__, texts, F.lit(0)).cast("long"))).first()
    chars = chars or 0
    ranges = max(1, -(-rows // range_rows), -(-chars // RANGE_CHARS), min(df.sparkSession.sparkContext.defaultParallelism, chars // LEAST_CHARS))
    # The upper bits of a row's number are those of its range.
    ranged = durable(df.withColumn("_k", key).repartitionByRange(ranges, *by, "_k").sortWithinPartitions(*by, "_k").drop("_k").withColumn(
        "_row", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_row", 33))
    so_far = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")).select(
        *[F.col(c).alias(f"_of_{c}") for c in [*by, "_range"]], (F.coalesce(F.sum("_n").over(so_far), F.lit(0)) - F.col("_first") + 1).alias("_more"))
    if sizes.count() <= SENT_ROWS:
        sizes = F.broadcast(sizes)
    same = F.lit(True)
    for c in [*by, "_range"]:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ranged.join(sizes, same).select(*df.columns, (F.col("_row") + F.col("_more")).cast("long").alias(name))


def next_in_group(df: DataFrame, by: Sequence[str], order: Sequence, value: str, name: str,
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """``value`` of the following row of the group.

    Rows that fit one range need one window over their groups; more are joined on exact positions, so a hot group spreads over all tasks.
    """
    by = list(by)
    df = durable(df)
    if df.count() <= range_rows:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*by).orderBy(*_key(order))))
    ranked = durable(rank_rows(df, by, order, "_i", range_rows))
    following = ranked.select(*by, (F.col("_i") - 1).alias("_i"), F.col(value).alias(name))
    return ranked.join(following, [*by, "_i"], "left").select(*df.columns, name)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence, n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows of every group. Up to ``GROUP_LIMIT`` the cut happens before the shuffle."""
    by = list(by)
    rank = name or "_rank"
    if n <= GROUP_LIMIT:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*_key(order))))
    else:
        ranked = rank_rows(df, by, order, rank)
    kept = ranked.filter(F.col(rank) <= n)
    return kept if name else kept.drop(rank)


def tiles(df: DataFrame, by: Sequence[str], order: Sequence, n: int, name: str, **kwargs) -> DataFrame:
    """``ntile(n)`` per group on top of :func:`rank_rows`."""
    ranked = durable(rank_rows(df, by, order, "_i", **kwargs))
    sizes = ranked.groupBy(*by).agg(F.max("_i").alias("_size"))
    q = F.floor(F.col("_size") / n)
    big = F.col("_size") - q * n
    i = F.col("_i")
    tile = F.when(i <= big * (q + 1), F.ceil(i / (q + 1))).otherwise(
        big + F.ceil((i - big * (q + 1)) / F.greatest(q, F.lit(1))))
    return ranked.join(sizes, list(by)).withColumn(name, tile.cast("int")).select(*df.columns, name)


def first_pages(df: DataFrame, n: int, site_col: str = "site_id", seq_col: str = "crawl_seq",
                name: str | None = None) -> DataFrame:
    """First ``n`` pages of each site in crawl order."""
    return top_n(df, [site_col], [seq_col], n, name)


def first_links(links: DataFrame, n: int) -> DataFrame:
    """First ``n`` links of each page, by position: a filter, no shuffle."""
    return links.filter(F.col("pos") < n)


def number_rows(df: DataFrame, order: Sequence, by: Sequence[str] = ("site_id",), name: str = "idx",
                **kwargs) -> DataFrame:
    """1-based numbering of briefs, drafts or calendar items per site."""
    return rank_rows(df, by, order, name, **kwargs)


def cap_pages(df: DataFrame, n: int, site_col: str = "site_id") -> DataFrame:
    """At most ``n`` pages per site, nearest to the start first."""
    return top_n(df, [site_col], ["depth", "url"], n)


def cap_sitemap(df: DataFrame, n: int, site_col: str = "site_id") -> DataFrame:
    """At most ``n`` sitemap URLs per site, in URL order."""
    return top_n(df, [site_col], ["url"], n)


def top_examples(facets: DataFrame, n: int) -> DataFrame:
    """First ``n`` values of each facet of each site, alphabetically."""
    return top_n(facets.select("site_id", "facet", "value").distinct(), ["site_id", "facet"], ["value"], n, "rank")
