"""Structured Streaming over training logs."""
