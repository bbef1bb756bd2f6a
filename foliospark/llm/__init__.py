"""Training-data operators: mixing, quality, deduplication, tokens, archives, packing, URL rules."""
