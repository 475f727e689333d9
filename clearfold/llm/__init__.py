"""Operators of a training-data pipeline: quality, deduplication, decontamination, mixing, output, extraction."""
