"""Training-data operators: deduplication, counting, packing and search over text tables."""
