"""Sitemap files to URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import trim_space, unescape
from ..functions.urls import site_of, url_part

_LOC = r"(?s)<loc(?:\s[^>]*)?>(.*?)</loc\s*>"


def parse_sitemap(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """``sitemap_url, url``: the trimmed text of every ``<loc>``; entries of an index file come out alike."""
    text = F.regexp_replace("_loc", r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
    return (
        df.select(*keep, "sitemap_url", F.explode(F.regexp_extract_all("body", F.lit(_LOC), F.lit(1))).alias("_loc"))
        .select(*keep, "sitemap_url", trim_space(
            F.when(F.col("_loc").contains("<![CDATA["), text).otherwise(unescape("_loc"))).alias("url"))
    )


def sitemap_urls(robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Distinct ``site_id, url`` of each site's sitemaps: those its robots.txt lists plus ``/sitemap.xml``.

    ``robots`` has ``host, sitemap_url`` rows, ``sitemaps`` the fetched bodies. Files are matched to
    sites before they are unpacked, so the join moves one row per file.
    """
    listed = robots.select(F.col("host").alias("site_id"), "sitemap_url")
    default = sitemaps.filter(url_part("sitemap_url", "PATH") == "/sitemap.xml").select(
        site_of("sitemap_url").alias("site_id"), "sitemap_url")
    owned = sitemaps.join(listed.unionByName(default).distinct(), "sitemap_url")
    return parse_sitemap(owned, keep=("site_id",)).select("site_id", "url").distinct()
