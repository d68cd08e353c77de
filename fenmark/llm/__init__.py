"""Training-data operators: scans, dedup, decontamination, quality and mixing.

Nothing outside this subpackage imports it.
"""
