"""Corpus preparation: token counts, dedup, scans, filters, packing, mixing, search and scoring."""
