"""Training-data operators: deduplication, filtering, scoring, formatting and packing of documents.

Nothing outside this subpackage imports it.
"""
