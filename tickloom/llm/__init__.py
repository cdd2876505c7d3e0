"""Training-data operators: filtering, mixing, tokens, media, PII, dedup and search."""
