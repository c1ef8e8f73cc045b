"""Readers."""

from taxograph.sources.tables import table

__all__ = ["table"]
