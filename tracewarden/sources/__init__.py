"""Readers and generators of spans."""
