"""Training-data operators: deduplication, scoring, archives, mixing, sharding, tokens.

Operators take any DataFrame with the columns they name and keep its other columns. Column names that
begin with two underscores are theirs.
"""
