"""Monitors and counters over streams of spans."""
