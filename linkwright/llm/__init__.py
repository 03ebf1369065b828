"""Training-data operators: filtering, deduplication, extraction, scoring, packing and tokenising of text corpora.

Nothing outside this subpackage imports it.
"""
