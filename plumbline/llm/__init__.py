"""Training-data operators: sharding, extraction, scans, dedup, packing, tokens, search.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
