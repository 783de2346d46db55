"""Operators of a training-data pipeline: extraction, cleaning, deduplication, scoring, mixing, tokens.

Nothing outside this subpackage imports it, apart from the guarded registration of its queries.
"""
