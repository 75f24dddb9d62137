"""Training-data operators: deduplication, mixing, tokenising, scanning and scoring of document tables.

Nothing outside this subpackage imports it.
"""
