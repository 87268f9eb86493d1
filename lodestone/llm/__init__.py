"""Training-data operators: deduplication, quality, safety, language, mixing and packing of document tables."""
