"""Operators of a training-data pipeline: extraction, packing, mixing, dedup, tokens, scoring and media."""
