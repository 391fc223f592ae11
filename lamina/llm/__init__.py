"""Operators of a training-data pipeline: deduplication, filtering, scoring,
tokenization, packing and archives. Nothing outside this folder imports it."""
