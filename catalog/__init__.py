"""Registered queries: each pairs a library call with SQL that computes the same from the tables."""
