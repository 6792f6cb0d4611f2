"""Profiling and anomaly analytics over tables of any size, on Spark."""
