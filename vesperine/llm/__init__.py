"""Training-data operators: decontamination, deduplication, mixing, secret
scans, language identification, language-model scoring and web archives.

Nothing outside this subpackage imports it.
"""
