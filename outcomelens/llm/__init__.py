"""Training-data operators: quality, dedup, secrets, mixing, tokens, models, search, archives."""
