"""Module catalogs as DataFrames: providers, aliases, docs, search, contracts."""
