"""Training-data operators: deduplication, filtering, archives, formatting and packing."""
