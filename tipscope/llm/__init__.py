"""Operators of a training-data pipeline: scoring, filtering, tokens, duplicates, packing, search."""
