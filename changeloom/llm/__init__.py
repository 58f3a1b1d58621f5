"""Training-data operators: deduplication, fingerprints, archives, packing, scoring."""
