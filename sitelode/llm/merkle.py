"""Merkle manifest of a table by lag and lead windows.

Every row is a leaf; rows of one tree (say, one language) stand in order, and runs of ``arity`` nodes of a level become one node of the
next until one is left. The trees' roots are the leaves of one more tree, whose root names the whole table.

A level is never a table of its own. In a window over leaves in order, the node over ``arity ** level`` leaves is kept by its first leaf,
so a node's siblings stand at fixed offsets: lag and lead columns of ``j * arity ** level`` rows, masked by the node's slot in its
run and by the end of the tree, give them, and the rows of first children hash the parents. Paths come back down the same way: a
node takes its parent's path by the lag of its slot.

Windows hold ``arity ** levels`` nodes, so a tree that has most of the rows is as many groups as it needs. What such a
group makes is one node; those nodes are the rows of the next step, of which there are as many as the largest tree needs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ranking import rank_rows
from ..session import durable
from .common import null_key

ARITY = 2
# Levels that one window climbs.
LEVELS = 8
# Most rows that one task ranks.
RANGE_ROWS = 1_000_000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other, as UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A value so that no two lists of values give the same bytes: its length in UTF-8 bytes, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return digest(*[field(v) for v in values])


def _over(levels: int, arity: int):
    chunk = F.floor(F.col("pos") / arity ** levels).cast("long")
    return chunk, Window.partitionBy("tree", "chunk").orderBy("pos")


def _first(stride: int) -> Column:
    return F.col("pos") % stride == 0


def _up(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``tree, pos, n, chunk, s, top`` from ``tree, pos, n, digest``: ``s`` has the siblings of the node of each level that the row keeps, ``top``
    is the node over the whole window, kept by its first row."""
    chunk, over = _over(levels, arity)
    rows = nodes.withColumn("chunk", chunk).withColumn("_0", F.col("digest"))
    siblings = []
    for level in range(levels):
        node, stride = F.col(f"_{level}"), arity ** level
        slot = F.floor(F.col("pos") / stride) % arity
        # A tree of one node has reached its root, which is passed on as it is.
        live = _first(stride) & (F.col("n") > stride)
        before = [F.when(slot >= j, F.lag(node, j * stride).over(over)) for j in range(arity - 1, 0, -1)]
        after = [F.when(slot + j < arity, F.lead(node, j * stride).over(over)) for j in range(1, arity)]
        joined = [F.concat(*[F.coalesce(x, F.lit("")) for x in side]) for side in (before, after)]
        rows = rows.withColumn(f"_s{level}", F.when(live, F.struct(joined[0].alias("before"), joined[1].alias("after"))))
        siblings.append(F.col(f"_s{level}"))
        parent = F.when(live, digest(node, F.col(f"_s{level}.after"))).otherwise(node)
        rows = rows.withColumn(f"_{level + 1}", F.when(_first(stride * arity), parent))
    kept = F.when(_first(arity ** levels), F.col(f"_{levels}"))
    return rows.select("tree", "pos", "n", "chunk", F.array(*siblings).alias("s"), kept.alias("top"))


def _down(rows: DataFrame, arity: int, levels: int) -> DataFrame:
    """``tree, pos, chunk, path`` from the result of :func:`_up`: siblings of every node from the row's own up to the window's top."""
    _, over = _over(levels, arity)
    none = F.array().cast(PATH)
    rows = rows.withColumn(f"_p{levels}", none)
    for level in reversed(range(levels)):
        stride, above = arity ** level, F.col(f"_p{level + 1}")
        slot = F.floor(F.col("pos") / stride) % arity
        parents = above
        for j in range(1, arity):
            parents = F.when(slot == j, F.lag(above, j * stride).over(over)).otherwise(parents)
        own = F.get("s", F.lit(level))
        path = F.concat(F.when(own.isNotNull(), F.array(own).cast(PATH)).otherwise(none), parents)
        rows = rows.withColumn(f"_p{level}", F.when(_first(stride), path))
    return rows.select("tree", "pos", "chunk", F.col("_p0").alias("path"))


def _prove(nodes: DataFrame, above: Callable[[DataFrame], DataFrame], largest: int, arity: int, levels: int) -> DataFrame:
    """``tree, pos, path, subroot, root`` from ``tree, pos, n, digest``. ``above`` gives ``tree, path, root`` from the trees' roots
    (``tree, digest``); ``largest`` is the size of the largest tree."""
    climbed = 1
    while climbed < levels and arity ** climbed < largest:
        climbed += 1
    span = arity ** climbed
    up = durable(_up(nodes, arity, climbed))
    tops = up.filter(_first(span)).select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("n") / span).cast("long").alias("n"),
                                          F.col("top").alias("digest"))
    if largest > span:
        higher = _prove(tops, above, -(-largest // span), arity, levels)
    else:
        roots = tops.select("tree", F.col("digest"))
        higher = roots.join(above(roots), "tree").select("tree", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    higher = durable(higher).select("tree", F.col("pos").alias("chunk"), F.col("path").alias("_up"), "subroot", "root")
    return _down(up, arity, climbed).join(higher, ["tree", "chunk"]).select(
        "tree", "pos", F.concat("path", "_up").alias("path"), "subroot", "root")


def _table_root(roots: DataFrame, arity: int, levels: int) -> DataFrame:
    """``tree, path, root`` of the tree over the trees' roots, in the order of their keys."""
    ranked = durable(rank_rows(roots.select(F.lit("").alias("_all"), "tree", "digest"), ["_all"], ["tree"], "_i"))
    n = ranked.count()
    nodes = ranked.select(F.col("_all").alias("tree"), (F.col("_i") - 1).alias("pos"), F.lit(n).cast("long").alias("n"), "digest")
    ends = lambda top: top.select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    proved = _prove(nodes, ends, n, arity, levels).select((F.col("pos") + 1).alias("_i"), "path", "root")
    return ranked.select("tree", "_i").join(proved, "_i").select("tree", "path", "root")


def manifest(docs: DataFrame, tree: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS,
             also: Mapping[str, Column] | None = None, arity: int = ARITY, levels: int = LEVELS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``<order>, leaf, path, subroot, root`` and the columns of ``also``, one row per row of ``docs``.

    ``leaf`` is the digest of ``fields``. Within each value of ``tree`` (null is a value, and the first) leaves ascend by ``order``, nulls
    first; rows equal in it go by leaf, and equal rows are interchangeable. Every ``arity`` consecutive nodes become one, the last run what
    there is, even one, until one remains: ``subroot``. The subroots, ascending by the UTF-8 bytes of ``tree``, likewise give ``root``. ``path``
    has for each level from the leaf to the root the digests of the run ``before`` and ``after`` the node, each joined in order.
    Other columns of ``docs`` play no part. Empty tables give no rows.
    """
    if arity < 2 or levels < 1:
        raise ValueError("arity must be at least 2 and levels at least 1")
    spark, also = docs.sparkSession, dict(also or {})
    kept = [c.alias(f"also{i}") for i, c in enumerate(also.values())]
    leaves = durable(docs.select(null_key(tree).alias("tree"), F.col(order).alias("ordinal"),
                                 leaf(*[F.col(c) for c in fields]).alias("digest"), *kept))
    # As many ranges as there are partitions, and more beyond what one task should rank.
    n, parts = leaves.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranked = durable(rank_rows(leaves, ["tree"], ["ordinal", "digest"], "place", max(1, min(range_rows, -(-n // parts)))))
    sizes = durable(ranked.groupBy("tree").agg(F.max("place").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    nodes = ranked.join(sizes, "tree").select("tree", (F.col("place") - 1).alias("pos"), "n", "digest")
    proved = _prove(nodes, lambda roots: _table_root(roots, arity, levels), largest, arity, levels)
    own = ranked.select("tree", (F.col("place") - 1).alias("pos"), "ordinal", "digest", *[f"also{i}" for i in range(len(also))])
    return own.join(proved, ["tree", "pos"]).select(
        F.col("ordinal").alias(order), F.col("digest").alias("leaf"), "path", "subroot", "root",
        *[F.col(f"also{i}").alias(name) for i, name in enumerate(also)])


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, from left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda node, s: digest(s["before"], node, s["after"]))
