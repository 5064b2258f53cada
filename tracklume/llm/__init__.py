"""Training-data operators: tokenizing, deduplication, extraction, filtering, packing.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
queries that the entry point registers when the subpackage is present.
"""
