"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What stands between words of most operators: ASCII white space.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_between(text: Column, gap: str) -> Column:
    """Words of a text, given the pattern of what stands between them; a null text has none. Splitting is many times
    faster than extracting all matches, which copies the text for each."""
    return F.coalesce(F.array_remove(F.split(text, gap), ""), F.array().cast("array<string>"))


def null_key(column: str) -> Column:
    """A string that is never null and tells null from every value, for joins on nullable keys."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo 3, is 1. Null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a string or binary array end to end, and the n + 1 row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else "")
    _, ends, data = column.buffers()
    if len(column) == 0 or ends is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + count), one range after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, counts)
