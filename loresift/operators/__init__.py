"""Extraction, indexing, search and maintenance operators over DataFrames."""
