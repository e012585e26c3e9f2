"""Training-data operators: deduplication, packing, decontamination, privacy, quality and formatting.

Nothing outside this subpackage imports it.
"""
