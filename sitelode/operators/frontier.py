"""Breadth-first reach over a stored link table, all sites at once."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, functions as F

from ..session import durable, durable_buckets, scratch_path
from .ranking import top_n
from .robots_filter import robots_allowed, robots_index

KEY = ["site_id", "url"]
# Visited tables of one size that are merged into a larger one.
RUNS = 8


def seed_urls(start: DataFrame, sitemap: DataFrame | None = None, max_sitemap: int | None = None) -> DataFrame:
    """Start URLs plus sitemap URLs (first ``max_sitemap`` per site in URL order), distinct."""
    if sitemap is None:
        return start.select(*KEY).distinct()
    listed = sitemap.select(*KEY).distinct()
    if max_sitemap is not None:
        listed = top_n(listed, ["site_id"], ["url"], max_sitemap)
    return start.select(*KEY).unionByName(listed).distinct()


def minus_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """Frontier rows whose (site, URL) was not visited."""
    return frontier.join(visited.select(*KEY), KEY, "left_anti")


def frontier_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """URLs of ``a`` without those of ``b``."""
    return a.join(b.select(*KEY), KEY, "left_anti")


def crawl_frontier(edges: DataFrame, seeds: DataFrame, rules: DataFrame | None = None, max_pages: int = 500,
                   links_per_page: int = 10, max_depth: int | None = None,
                   stored: DataFrame | None = None) -> DataFrame:
    """Pages reached per site: ``site_id, url, depth`` (depth 0 = seed).

    ``edges`` has ``site_id, src, dst, pos``; the first ``links_per_page`` links of a page are followed.
    Per level: links of the new pages, minus pages already taken, minus disallowed, capped so that a site
    never exceeds ``max_pages`` (order: depth, then URL). A disallowed URL is neither a page nor followed.
    With ``stored``, URLs that have no stored page yield nothing either.

    Links and visited URLs lie in buckets by (site, URL), so a level shuffles only its new links: what was visited and what the
    new pages link to is joined where it lies. ``RUNS`` visited tables of a size are merged into one, so a URL is written again
    only log(levels) times and a deep site joins few tables. Rules and stored pages are written once before the first
    level. Each level adds its pages per site to a small table of counts, which gives the room left without reading earlier
    levels, and sites without room are no longer followed. The driver only learns whether a level was empty.
    """
    spark = edges.sparkSession
    counts = scratch_path(spark, "frontier-counts")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    followed = durable_buckets(
        edges.filter(F.col("pos") < links_per_page).select("site_id", F.col("src").alias("url"), "dst").distinct(), KEY, buckets)
    rules = None if rules is None else durable(robots_index(rules))
    stored = None if stored is None else durable_buckets(stored.select(*KEY).distinct(), KEY, buckets)

    def used() -> DataFrame:
        rows = spark.read.schema("site_id string, n long, depth int").parquet(counts)
        return rows.groupBy("site_id").agg(F.sum("n").alias("_used"))

    visited: list[list[DataFrame]] = [[]]
    found = seeds.select(*KEY).distinct()
    depth = 0
    while max_depth is None or depth <= max_depth:
        for run in chain(*visited):
            found = minus_visited(found, run)
        if rules is not None:
            found = robots_allowed(found, rules)
        if stored is not None:
            found = found.join(stored, KEY, "left_semi")
        level = top_n(found, ["site_id"], ["url"], max_pages, "_n")
        if depth:
            level = level.join(used(), "site_id", "left").filter(
                F.col("_n") + F.coalesce("_used", F.lit(0)) <= max_pages)
        fresh = durable_buckets(level.select(*KEY, F.lit(depth).alias("depth")), KEY, buckets)
        if fresh.isEmpty():
            break
        fresh.groupBy("site_id").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{counts}/depth={depth}")
        _file_run(visited, fresh, buckets)
        full = used().filter(F.col("_used") >= max_pages).select("site_id")
        links = fresh.select(*KEY).join(followed, KEY).select("site_id", F.col("dst").alias("url"))
        found = links.join(full, "site_id", "left_anti").distinct()
        depth += 1
    none = spark.createDataFrame([], "site_id string, url string, depth int")
    return reduce(DataFrame.unionByName, chain(*visited), none)


def _file_run(visited: list[list[DataFrame]], run: DataFrame, buckets: int) -> None:
    """Add a run to the first rank; a rank that holds ``RUNS`` runs becomes one run of the next."""
    visited[0].append(run)
    for rank, runs in enumerate(visited):
        if len(runs) < RUNS:
            break
        if rank + 1 == len(visited):
            visited.append([])
        visited[rank + 1].append(durable_buckets(reduce(DataFrame.unionByName, runs), KEY, buckets))
        runs.clear()


def coverage(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Per site: stored pages, pages reached, and stored pages that were reached."""
    both = pages.select(*KEY, F.lit(1).alias("stored")).distinct().join(
        frontier.select(*KEY, F.lit(1).alias("reached")).distinct(), KEY, "full")
    one = F.lit(1)
    return both.groupBy("site_id").agg(
        F.count("stored").alias("pages_stored"), F.count("reached").alias("pages_reached"),
        F.count(F.when(F.col("stored").isNotNull() & F.col("reached").isNotNull(), one)).alias("stored_reached"))
