"""A PySpark engine for retail price intelligence: matching, pricing, auditing and history over DataFrames."""
