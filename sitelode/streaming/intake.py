"""Incremental page intake: each (site, URL) is taken once."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import html as H
from ..functions.text import word_count
from ..functions.urls import site_of
from ..schema import PAGES
from ..session import path_exists


def arriving_pages(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Streaming pages with ``site_id`` and time of arrival, repeats included."""
    landed = (
        spark.readStream.schema(PAGES).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
        .parquet(path).withColumn("arrived_at", F.col("_metadata.file_modification_time"))
    )
    return landed.filter(F.col("html").isNotNull() & (F.col("html") != "")).select(
        site_of("url").alias("site_id"), F.col("page_id").alias("crawl_seq"), "url", "html", "arrived_at")


def stream_pages(spark: SparkSession, path: str, watermark: str = "1 day", glob: str = "*.parquet",
                 files_per_batch: int = 1000) -> DataFrame:
    """Streaming pages with ``site_id``, first arrival of each URL only.

    Duplicate detection keeps (site, URL) state for ``watermark`` of arrival time: a URL that comes again
    later than that is taken anew, and state does not grow with the corpus. :func:`take_pages` never takes a URL again.
    """
    arrived = arriving_pages(spark, path, glob, files_per_batch)
    return arrived.withWatermark("arrived_at", watermark).dropDuplicatesWithinWatermark(["site_id", "url"])


def parse_stream(pages: DataFrame) -> DataFrame:
    """Title, visible text and word count of streamed pages."""
    return pages.select(
        "site_id", "crawl_seq", "url", H.page_title("html").alias("title"),
        H.visible_text("html").alias("text_content"),
    ).withColumn("word_count", word_count("text_content"))


def write_stream(df: DataFrame, path: str, checkpoint: str):
    """Append to Parquet with the file sink's exactly-once log; stops when the input is used up."""
    return (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _key() -> Column:
    """128-bit digest of (site, URL); a site or URL that is missing differs from an empty one."""
    parts = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("site_id", "url")]
    return F.unhex(F.md5(F.concat_ws("\n", *parts)))


def take_pages(pages: DataFrame, path: str, checkpoint: str, transform=parse_stream):
    """Store ``transform`` of the streamed ``pages`` so that a (site, URL) is stored once, however late it returns.

    Beside the pages lies an index of the keys taken (``<path>-keys``), 16 bytes a page. A batch keeps its first arrival of each
    key, leaves out those in the index, writes the pages and then their keys. Both are written under a name made of
    the checkpoint and the batch, and the batch's own keys are not asked: a batch that is run again after a failure
    replaces its own output with the same rows. A stream that starts anew with another checkpoint adds nothing
    that is stored. Only keys meet the index; pages join those left by the key. One stream writes to a ``path`` at a time.
    Stops when the input is used up; ``read_pages_taken`` reads the pages back.
    """
    run = sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, batch_id: int) -> None:
        spark, own = batch.sparkSession, f"{run}-{batch_id}"
        keyed = batch.withColumn("_key", _key())
        first = keyed.groupBy("_key").agg(F.min(F.struct("arrived_at", "crawl_seq", F.xxhash64("html"))).alias("_first"))
        if path_exists(spark, f"{path}-keys"):
            taken = spark.read.schema("key binary, batch string").parquet(f"{path}-keys").filter(F.col("batch") != own)
            first = first.join(taken.select(F.col("key").alias("_key")), "_key", "left_anti")
        order = F.struct("arrived_at", "crawl_seq", F.xxhash64("html"))
        fresh = keyed.withColumn("_order", order).join(first, "_key").filter(F.col("_order").eqNullSafe(F.col("_first")))
        fresh = fresh.dropDuplicates(["_key"]).drop("_order", "_first")
        transform(fresh).write.mode("overwrite").parquet(f"{path}/batch={own}")
        stored = spark.read.parquet(f"{path}/batch={own}")
        stored.select(_key().alias("key")).write.mode("overwrite").parquet(f"{path}-keys/batch={own}")

    return (
        pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_pages_taken(spark: SparkSession, path: str) -> DataFrame:
    """Pages that :func:`take_pages` stored under ``path``."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")
