"""Readers: stored pages, robots.txt bodies, sitemaps, reports."""
from .pages import read_pages, read_report, site_pages, text_pages
from .robots import parse_robots, robots_arrays, robots_sitemaps
from .sitemaps import parse_sitemap, sitemap_urls

__all__ = ["read_pages", "read_report", "site_pages", "text_pages", "parse_robots", "robots_arrays",
           "robots_sitemaps", "parse_sitemap", "sitemap_urls"]
