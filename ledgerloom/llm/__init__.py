"""Training-data operators: deduplication, filtering, mixing and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
