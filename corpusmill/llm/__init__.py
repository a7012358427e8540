"""Operators of a training-data pipeline: tokens, search, packing, dedup, quality, mixing, sharding, output.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries only when it is present.
"""
