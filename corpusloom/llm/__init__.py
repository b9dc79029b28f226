"""Training-data operators: dedup, search, packing, formatting, filters, mixing, token files."""
