"""Operators for large text corpora: search, token counts, near duplicates, filters, packing."""
