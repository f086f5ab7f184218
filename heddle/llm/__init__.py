"""Training-data operators: token counts, near-duplicates, packing, scans and codecs."""
