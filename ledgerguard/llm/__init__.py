"""Training-data operators: token files, revisit resolution, deduplication, quality rules, packing, PII.

Nothing else in the library imports this subpackage.
"""
