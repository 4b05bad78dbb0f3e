"""Training-data operators: filtering, deduplication, tokenisation. Nothing outside imports this package."""
