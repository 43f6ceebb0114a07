"""Rendered reports and writers."""
