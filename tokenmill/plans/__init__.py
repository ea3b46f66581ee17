"""Fixtures derived from the input tables, and the registered queries."""
