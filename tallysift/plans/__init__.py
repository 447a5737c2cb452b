"""Operators composed into the workflows a user calls."""
