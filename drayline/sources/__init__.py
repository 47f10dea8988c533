"""Readers of stored tables and of legacy text files."""

from drayline.sources.tables import read_table

__all__ = ["read_table"]
