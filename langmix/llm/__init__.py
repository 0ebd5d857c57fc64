"""Training-data operators: deduplication, quality, URL rules, tokens, mixing and packing.

Nothing else in the library imports this subpackage; it imports only general helpers.
"""
