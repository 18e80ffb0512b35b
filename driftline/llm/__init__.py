"""Training-data operators: dedup, filtering, packing, search, mixing and binary output."""
