"""Operators for preparing training data: matching, grouping, packing, leak and truncation search."""
