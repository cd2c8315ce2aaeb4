"""Training-data operators: deduplication, filtering, scoring, mixing, packing and token output.

Nothing else in the library imports this subpackage.
"""
