"""Training-data operators: sharding, deduplication, extraction, identification, mixing and archives.

Nothing outside this subpackage imports it.
"""
