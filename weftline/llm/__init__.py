"""Training-data operators: dedup, filters, packing, search and sharding on DataFrames.

Nothing else in the library imports this subpackage.
"""
