"""Training-data operators: deduplication, classification, mixing, counting and scanning."""
