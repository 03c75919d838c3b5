"""Operators of a training-data pipeline: mixing, packing, deduplication, language, toxicity, archives.

Each module holds one operator with a general interface; ``queries`` holds the thin queries over the
given tables. Nothing outside this subpackage imports it.
"""
