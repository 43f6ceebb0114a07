"""Distributed writers. Every file is written by the executors; nothing is gathered first."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import path_exists
from . import render as R

FORMATS = ("json", "csv", "parquet")
# Spark's setting for the files that one task keeps open.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def write_rendered(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rendered JSON rows (column ``content``) as JSON lines."""
    df.select("content").write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite",
                partition_by: tuple[str, ...] = (), compression: str | None = None) -> None:
    """A table in the chosen export format; ``excel`` is written as CSV, which spreadsheets open. ``compression`` as Spark names it."""
    fmt = "csv" if fmt == "excel" else fmt
    if fmt not in FORMATS:
        raise ValueError(f"unknown export format: {fmt}")
    writer = (R.keywords_csv(df) if fmt == "csv" else df).write.mode(mode).partitionBy(*partition_by)
    if partition_by:  # overwrite the folders that have new rows, and no others
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def _taken(spark, path: str, fmt: str, keys: DataFrame) -> list[str]:
    """Up to five clients and runs of ``keys`` that the layout under ``path`` already has."""
    if not path_exists(spark, path):
        return []
    have = spark.read.schema("client_slug string, run_ts string").format("csv" if fmt == "excel" else fmt).load(path).distinct()
    both = keys.distinct().join(have, ["client_slug", "run_ts"], "left_semi").orderBy("client_slug", "run_ts").limit(5)
    return [f"{r['client_slug']} {r['run_ts']}" for r in both.collect()]


def lies_by_client(placed: DataFrame) -> bool:
    """Whether writing rows where they lie gives few files: at most two for each client and task that has rows."""
    parts = placed.select("client_slug", F.spark_partition_id().alias("_p")).distinct()
    files, clients, tasks = parts.agg(F.count(F.lit(1)), F.count_distinct("client_slug"), F.count_distinct("_p")).first()
    return files <= 2 * max(clients, tasks)


@contextmanager
def open_files(spark: SparkSession):
    """A task that writes into several folders keeps their files open instead of sorting its rows by folder first."""
    before = spark.conf.get(OPEN_FILES)
    spark.conf.set(OPEN_FILES, "32")
    try:
        yield
    finally:
        spark.conf.set(OPEN_FILES, before)


def write_layout(df: DataFrame, path: str, names: DataFrame, run_ts: Column, fmt: str = "parquet", replace: bool = False,
                 lying: bool = False) -> None:
    """Export layout ``client_slug=…/run_ts=…``.

    Only the folders of the clients and runs in ``df`` are written; those of other clients and of earlier runs stay as they are. A client's run
    that is already there is an error unless ``replace``, which writes its folder anew.

    A rebalance by client puts a small client's rows in one file; AQE splits the partition of a large client by size, so no single
    task writes all of it. With ``lying``, for long rows that are read from a table, rows that lie by client already, as ranked ones do, are not moved
    (:func:`lies_by_client`): a task writes a file for each client it has. JSON lines are written as gzip: rendered texts say much several times. CSV stays plain, for spreadsheets.
    """
    placed = R.client_layout(df, names, run_ts)
    if not replace and (taken := _taken(df.sparkSession, path, fmt, placed.select("client_slug", "run_ts"))):
        raise FileExistsError(f"already exported to {path}: {', '.join(taken)}")
    compression = "gzip" if fmt == "json" else None
    if lying and lies_by_client(placed):
        with open_files(df.sparkSession):
            write_table(placed, path, fmt, partition_by=("client_slug", "run_ts"), compression=compression)
    else:
        write_table(placed.hint("rebalance", "client_slug"), path, fmt, partition_by=("client_slug", "run_ts"), compression=compression)
