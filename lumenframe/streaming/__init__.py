"""Counters over unbounded input."""
