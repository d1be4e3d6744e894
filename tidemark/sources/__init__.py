"""Readers and writers."""
from tidemark.sources.tables import TABLES, load

__all__ = ["TABLES", "load"]
