"""Training-data operators: tokenising, language ID, deduplication, decontamination, scoring and archives.

Nothing outside this subpackage imports it.
"""
