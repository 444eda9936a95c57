"""Training-data operators: scoring, cleaning, deduplication and packing of documents.

Nothing outside this subpackage imports it.
"""
