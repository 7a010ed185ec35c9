"""Counts over streams of records."""
