"""Sequence files as Spark data sources."""
