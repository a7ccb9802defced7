"""Training-data operators: quality, deduplication, tokens, toxicity, extraction and packing."""
