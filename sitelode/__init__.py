"""Spark-native analysis of stored website content, many sites at once.

Every operator takes and returns DataFrames (or Columns) keyed by ``site_id``; nothing
passes through the driver except loop-termination counts.
"""
__version__ = "0.1.0"
