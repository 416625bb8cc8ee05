"""Column expressions: text normalisation, product features, prices, keys and similarity."""
