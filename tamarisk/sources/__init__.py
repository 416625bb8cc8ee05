"""Readers: catalogues, store exports, registries, sitemaps and pasted tables."""
