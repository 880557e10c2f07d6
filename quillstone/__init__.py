"""Faceted search, versioned computed columns and certified reuse on Spark DataFrames."""
