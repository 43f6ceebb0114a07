"""Structured Streaming intake and job state."""
