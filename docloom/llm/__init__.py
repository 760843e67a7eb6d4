"""Training-data operators: quality, deduplication, packing, extraction and scoring over document tables."""
