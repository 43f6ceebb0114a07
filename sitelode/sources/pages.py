"""Page and report readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.urls import site_of
from ..schema import PAGES, REPORT


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Stored pages; failed downloads (no HTML) are dropped at the scan."""
    pages = spark.read.schema(schema).parquet(path)
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != ""))


def site_pages(pages: DataFrame) -> DataFrame:
    """Add ``site_id`` (host) and ``crawl_seq`` (page_id)."""
    return pages.select(site_of("url").alias("site_id"), F.col("page_id").alias("crawl_seq"), "url", "html")


def text_pages(documents: DataFrame) -> DataFrame:
    """Plain documents as already-parsed pages: source is the site, doc_id the crawl order."""
    return documents.select(
        F.col("source").alias("site_id"), F.col("doc_id").alias("crawl_seq"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("text_content"),
    )


def read_report(spark: SparkSession, path: str, schema: str = REPORT, multi_line: bool = True) -> DataFrame:
    """Load JSON reports back with a declared schema: pretty-printed files, or JSON lines."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)
