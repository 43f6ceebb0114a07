"""Which URLs robots.txt allows, and which links stay on the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import apply_sql, sql_let
from ..functions.urls import path_and_query, percent_decode, url_part


def robots_index(rules: DataFrame) -> DataFrame:
    """``host, lengths, slots``: the rules of a host as a hash table in one row; an index comes back as it is.

    ``rules`` are rule rows (``host, seq, allow, prefix``) or one array per host (``host, rules``, in file order). Of rules with one prefix only
    the first in file order can match, so a prefix has one entry; it stands in the slot that its hash names, and there are as
    many slots as prefixes. ``lengths`` are the prefix lengths that occur. The row is bounded by the size of a robots.txt file.
    """
    if "slots" in rules.columns:
        return rules
    if "rules" in rules.columns:
        rules = rules.select("host", F.posexplode("rules").alias("seq", "_rule")).select("host", "seq", "_rule.allow", "_rule.prefix")
    first = rules.filter(F.col("prefix").isNotNull()).groupBy("host", "prefix").agg(F.min(F.struct("seq", "allow")).alias("_r"))
    sizes = first.groupBy("host").agg(
        F.count(F.lit(1)).alias("_n"), F.collect_set(F.length("prefix")).alias("lengths"))
    entry = F.struct("_r.seq", "_r.allow", "prefix")
    filed = first.join(sizes.select("host", "_n"), "host").select(
        "host", F.pmod(F.xxhash64("prefix"), F.col("_n")).alias("_slot"), entry.alias("_entry"))
    empty = sizes.select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_slot"),
                         F.lit(None).cast(filed.schema["_entry"].dataType).alias("_entry"))
    slots = filed.unionByName(empty).groupBy("host", "_slot").agg(F.collect_list("_entry").alias("_entries")).groupBy("host").agg(
        F.array_sort(F.collect_list(F.struct("_slot", "_entries"))).alias("_slots"))
    return slots.join(sizes.select("host", "lengths"), "host").select(
        "host", "lengths", F.transform("_slots", lambda s: s["_entries"]).alias("slots"))


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``allow``: the first rule in file order whose prefix the URL's path and query start with.

    A URL meets the index of its host (:func:`robots_index`) in one row: for each length that the host's prefixes have, the head of
    the path is looked up in the slot of its hash, so a URL costs its number of lengths, not of rules. The join neither
    multiplies URLs nor needs a regrouping. Hosts without rules allow everything. The join carries no hint: Spark decides from
    the sizes it measures.
    """
    per_host = robots_index(rules).select(F.col("host").alias("_host"), "lengths", "slots")
    path = percent_decode(path_and_query(url_col))
    met = "filter(get(slots, cast(pmod(xxhash64(rh), size(slots)) as int)), re -> re.prefix = rh)"
    found = f"transform(filter(lengths, rl -> rl <= length(rp)), rl -> {sql_let('substr(rp, 1, rl)', 'rh', f'get({met}, 0)')})"
    joined = urls.withColumn("_host", url_part(url_col, "AUTHORITY")).join(per_host, "_host", "left")
    first = apply_sql(path, "rp", f"array_min(array_compact({found})).allow")
    return joined.withColumn("allow", F.coalesce(first, F.lit(True))).select(*urls.columns, "allow")


def robots_allowed(urls: DataFrame, rules: DataFrame, respect_robots: bool = True, url_col: str = "url") -> DataFrame:
    """URLs that may be visited."""
    if not respect_robots:
        return urls
    return match_rules(urls, rules, url_col).filter("allow").drop("allow")


def same_domain(links: DataFrame, target_col: str = "target", page_col: str = "url") -> DataFrame:
    """Links whose authority is the page's own."""
    return links.filter(url_part(target_col, "AUTHORITY") == url_part(page_col, "AUTHORITY"))
