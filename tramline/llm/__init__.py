"""Training-data operators: deduplication, filtering, redaction, mixing, packing and sharding of text corpora."""
