"""Spark analytics for tiered document processing."""

__version__ = "0.1.0"
