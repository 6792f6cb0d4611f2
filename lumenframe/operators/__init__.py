"""Detectors and profiles: each takes a DataFrame and returns one."""
