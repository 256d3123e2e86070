"""Training-data operators: cleaning, dedup, search, scoring, tokenising and packing of document tables.

Nothing else in the library imports this subpackage.
"""
