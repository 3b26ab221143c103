"""Training-data operators: packing, tokenising, near-duplicate search, filters.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present.
"""
