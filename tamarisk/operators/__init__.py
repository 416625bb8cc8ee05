"""Relational operators over catalogues and offers."""
