"""Operators of a training-data pipeline: quality, packing, extraction, near and exact duplicates, decontamination."""
