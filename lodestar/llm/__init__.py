"""Training-data operators: quality, deduplication, tokens, packing, secrets, markup and audio columns."""
