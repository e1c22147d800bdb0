"""Training-data operators: scoring, privacy, packing, near-duplicates, leaks and web archives."""
