"""Readers and writers."""

from tokenmill.sources.tables import read_table  # noqa: F401
