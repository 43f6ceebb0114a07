"""Set-similarity join: which word sets of a site are alike, without pairs of all sets.

Sets of ``n`` and ``m`` words have a Jaccard similarity of at least ``t`` exactly when they have ``o = ceil(t * (n + m) / (1 + t))`` words in
common. So sets meet by their sizes:

* ``o`` is 1 or 2: sets that share a word, or two, are alike, and nothing is left to verify. The word or pair is their mark; a mark links
  all that have it, without pairs.
* ``o`` is 3 or more: with words in one order, rare ones first, two such sets have one of their first ``n - o + 1`` and ``m - o + 1`` words in
  common. Sets that meet in such a word, at places after which ``o`` common words can still follow, are compared.

A word in which more than ``full`` sets meet is dealt to pairs of blocks of that size; a block pair gives links that span its groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable

# Most sets that meet in one word and are compared by a join; sets in a block beyond that.
FULL = 256


def overlap(n: int, m: int, threshold: float) -> int:
    """Words that sets of ``n`` and ``m`` words must share."""
    return int(np.ceil((n + m) * threshold / (1 + threshold) - 1e-9))


def similar_sizes(sizes: list[int], threshold: float) -> list[tuple[int, int, int]]:
    """``a, b, o`` for sizes ``a <= b`` of sets that can be alike."""
    return [(a, b, o) for a in sizes for b in sizes if 0 < a <= b and (o := overlap(a, b, threshold)) <= a]


def _by_rarity(sets: DataFrame) -> DataFrame:
    """``node, site_id, words``: words in ascending order of how many sets of the site have them."""
    words = sets.select("node", "site_id", F.explode("words").alias("w"))
    often = words.groupBy("site_id", "w").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.join(often, ["site_id", "w"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("r"))
    return ranked.select("node", F.col("node.site_id").alias("site_id"), F.transform("r", lambda x: x["w"]).alias("words"))


def _partners(pairs: list[tuple[int, int, int]], n: Column) -> Column:
    """Pairs of sizes that a set of ``n`` words takes part in."""
    every = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(o).alias("o")) for a, b, o in pairs])
    return F.filter(every, lambda p: (p["a"] == n) | (p["b"] == n))


def _marks(sets: DataFrame, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """``node, sig`` for sizes whose sets are alike by one or two words: marks that some set of either size has."""
    met = sets.select("node", "site_id", F.size("words").alias("n"), "words", F.explode(_partners(pairs, F.size("words"))).alias("p"))
    twos = F.flatten(F.transform("words", lambda x, i: F.transform(
        F.slice("words", i + 2, F.size("words")), lambda y: F.concat(x, F.lit(" "), y))))
    marked = met.select("node", "n", "p.a", "p.b", "site_id", F.explode(F.when(F.col("p.o") == 1, F.col("words")).otherwise(twos)).alias("mark"))
    marked = durable(marked.select("node", "n", "a", "b", F.struct("site_id", F.concat_ws("/", "a", "b", "mark").alias("mark")).alias("sig")))
    linking = marked.groupBy("sig", "a", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count(F.lit(1)).alias("c")).filter(
        F.when(F.col("a") == F.col("b"), F.col("c") > 1).otherwise(F.col("low") < F.col("high")))
    return marked.join(linking.select("sig"), "sig", "left_semi").select("node", "sig")


def _spanning(sets: list[frozenset], a: int, b: int, o: int) -> list[tuple[int, int]]:
    """Links that span the groups of alike sets of a block pair. Each search takes all that it reaches out of the rest, so a large group of
    close sets costs few passes."""
    sizes = np.array([len(s) for s in sets])
    column: dict[str, int] = {}
    for s in sets:
        for w in s:
            column.setdefault(w, len(column))
    has = np.zeros((len(sets), len(column)), np.uint8)
    for i, s in enumerate(sets):
        has[i, [column[w] for w in s]] = 1
    rest, links = np.arange(len(sets)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            common = has[rest][:, has[at] > 0].sum(1, dtype=np.int64)
            near = (common >= o) & ((sizes[rest] != sizes[at]) if a != b else True)
            hit = rest[near]
            links += [(int(at), int(j)) for j in hit]
            queue += list(hit)
            rest = rest[~near]
    return links


def _span_group(group: pa.Table) -> pa.Table:
    rows = group.select(["a", "b", "o"]).slice(0, 1).to_pylist()[0]
    found = _spanning([frozenset(w) for w in group.column("words").to_pylist()], rows["a"], rows["b"], rows["o"])
    node = group.column("node").combine_chunks()
    take = lambda k: node.take(pa.array([x[k] for x in found], pa.int64()))
    return pa.table({"l": take(0), "r": take(1)})


def _verified(sets: DataFrame, pairs: list[tuple[int, int, int]], full: int) -> DataFrame:
    """``l, r``: links between sets of sizes that need three or more common words, which join the same groups as all such links do."""
    ranked = durable(_by_rarity(sets))
    n = F.size("words")
    met = ranked.select("node", "site_id", "words", n.alias("n"), F.explode(_partners(pairs, n)).alias("p"))
    keyed = met.select("node", "n", "words", "p.a", "p.b", "p.o", "site_id", F.posexplode(
        F.slice("words", 1, F.col("n") - F.col("p.o") + 1)).alias("at", "w"))
    key = ["site_id", "a", "b", "w"]
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high")).filter(
        "c > 1 and (a = b or low < high)").select(*key, "c")
    keyed = durable(keyed.join(counts, key))
    few = keyed.filter(F.col("c") <= full)
    x, y = few.filter("n = a").alias("x"), few.filter("n = b").alias("y")
    same = F.col("x.w") == F.col("y.w")
    for c in ("site_id", "a", "b"):
        same &= F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
    # Enough words can follow the place where they meet, and a pair of equal sizes comes once.
    follow = 1 + F.least(F.col("x.n") - 1 - F.col("x.at"), F.col("y.n") - 1 - F.col("y.at")) >= F.col("x.o")
    once = (F.col("x.a") < F.col("x.b")) | (F.col("x.node") < F.col("y.node"))
    enough = F.size(F.array_intersect("x.words", "y.words")) >= F.col("x.o")
    links = x.join(y, same & follow & once).filter(enough).select(F.col("x.node").alias("l"), F.col("y.node").alias("r"))

    many = keyed.filter(F.col("c") > full)
    if many.isEmpty():
        return links
    blocks = F.ceil(2 * F.col("c") / full).cast("int")
    dealt = many.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("node", "words", *key, "o", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = sets.schema["node"].dataType.simpleString()
    return links.unionByName(dealt.groupBy(*key, "i", "j").applyInArrow(_span_group, f"l {kind}, r {kind}"))


def similar_sets(sets: DataFrame, threshold: float = 0.5, full: int = FULL) -> DataFrame:
    """``node, sig`` from ``node`` (a struct with ``site_id``), ``site_id, words`` (distinct words; one row per set): nodes
    that share a ``sig`` belong to one group, and the groups are those that a Jaccard similarity of ``threshold`` or more links, within
    a site. Sets without a partner are left out. Every link is found; none is listed twice for sets that agree in a mark."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    sizes = sorted(r["n"] for r in sets.select(F.size("words").alias("n")).distinct().collect())
    pairs = similar_sizes(sizes, threshold)
    # Different sets of a size that leaves no word to differ are never alike.
    pairs = [(a, b, o) for a, b, o in pairs if not (a == b == o)]
    marks = _marks(sets, [p for p in pairs if p[2] <= 2] or [(0, 0, 1)])
    hard = [p for p in pairs if p[2] > 2]
    if not hard:
        return marks
    links = durable(_verified(sets, hard, full).distinct())
    sig = F.struct(F.col("l.site_id").alias("site_id"), F.concat_ws("/", F.lit("pair"), F.hex(F.col("l.term")), F.hex(F.col("r.term"))).alias("mark"))
    ends = links.select(F.explode(F.array("l", "r")).alias("node"), sig.alias("sig"))
    return marks.unionByName(ends)
