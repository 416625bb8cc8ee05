"""Training-data operators: near-duplicates, language, quality, tokens, secrets, shards, search and packing."""
